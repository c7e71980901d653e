"""Pairs of texts whose sets of 5-word shingles have a Jaccard similarity of SIMILAR or more.

Candidates share the least hashes of one of BANDS bands; a pair at exactly 0.8
has no band in common with a chance of (1 - 0.8^ROWS)^BANDS, 3 in a million,
and every candidate is confirmed with the whole sets. Equal sets collapse
first. A band shared by at most CROWD sets gives its pairs; a larger one is
dealt over blocks of bounded size, in which all sets are compared at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, raw

WIDTH = 5
#: 0.8 as a fraction: shared shingles i of sets of a and b are enough if (4 + 5) i >= 4 (a + b).
SIMILAR = (4, 5)
BANDS, ROWS = 24, 4
CROWD = 16
#: Shingles and sets of half a block, about.
HALF_SHINGLES, HALF_SETS = 100_000, 400
CACHE = 50_000
#: Bits of the map of candidates, which spares writing most other sets.
MAP_BITS = 22
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_RNG = np.random.default_rng(17)
_XOR, _MUL = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_MUL |= np.uint64(1)

_words: dict[bytes, int] = {}


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    got = list(map(_words.get, words))
    if None in got:
        if len(_words) >= CACHE:
            _words.clear()
        for k, x in enumerate(got):
            if x is None:
                got[k] = x = xxhash.xxh64_intdigest(words[k])
                if len(words[k]) <= 64:
                    _words[words[k]] = x
    w = np.array(got, np.uint64)
    n = len(w) - WIDTH + 1
    h = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        h = (h ^ w[k : k + n]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_id(x: np.ndarray) -> int:
    """Signed hash of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64))


def bands(x: np.ndarray) -> list[int]:
    """One key for each band of least hashes; none for an empty set."""
    if not len(x):
        return []
    least = np.min([((x[at : at + 2048, None] ^ _XOR) * _MUL).min(0) for at in range(0, len(x), 2048)], axis=0)
    return [int(np.uint64(xxhash.xxh64_intdigest(least[j * ROWS : (j + 1) * ROWS].tobytes(), j)).astype(np.int64)) for j in range(BANDS)]


def enough(shared: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of so many shingles together that share so many are similar."""
    p, q = SIMILAR
    return (p + q) * shared >= p * sizes


def _confirm(b: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for k, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)):
            keep.append(k)
    return b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _compare(t: pa.Table) -> pa.Table:
    """Links (a, b) that join all similar sets of a block."""
    ids = t["set_id"].to_numpy()
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["x"]]
    n = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    place = np.cumsum(times > 1) - 1  # shingles of one set alone are shared with none
    row, column = row[times[column] > 1], place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        shared += m @ m.T
    near = enough(shared.astype(np.int64), n[:, None] + n[None])
    left, a, b = np.ones(len(sets), bool), [], []
    for k in range(len(sets)):
        todo = [k] if left[k] else []
        left[k] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            a += [int(ids[i])] * len(new)
            b += ids[new].tolist()
            todo += new.tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and x, the shingles as bytes, of at least the wanted sets (one column set_id), each once."""
    marks = np.zeros(1 << MAP_BITS, bool)
    marks[wanted.select(F.pmod("set_id", F.lit(1 << MAP_BITS)).alias("at")).distinct().toArrow()["at"].to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))  # 2^MAP_BITS bits

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bits, ids, out = sent.value, [], []
        for t in raw(b):
            x = shingles(t)
            at = (i := set_id(x)) % (1 << MAP_BITS)
            if len(x) and bits[at >> 3] >> (7 - (at & 7)) & 1:
                ids.append(i)
                out.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["set_id", "x"])

    return cut(map_arrow(docs.select("text"), run, "set_id long, x binary").dropDuplicates(["set_id"]))


def similar(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of set ids whose transitive closure is that of all similar pairs of sets.

    sets has one row for each distinct set: set_id, its size n, and its band keys; docs has the texts.
    """
    band = sets.select("set_id", "n", F.explode("keys").alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    cand = cut(band.join(shared.hint("merge"), "key"))
    few = cand.where(F.col("m") <= CROWD)
    one, two = (few.select("key", F.col("set_id").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    p, q = SIMILAR
    close = q * F.least("na", "nb") >= p * F.greatest("na", "nb")
    pairs = cut(one.join(two.hint("merge"), "key").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct())
    many = cand.where(F.col("m") > CROWD)
    x = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(many.select("set_id")))

    both = pairs.join(x.select(F.col("set_id").alias("a"), "x").hint("merge"), "a").join(x.select(F.col("set_id").alias("b"), F.col("x").alias("y")).hint("merge"), "b")
    found = cut(map_arrow(both.select("a", "b", "x", "y"), _confirm, "a long, b long"), pairs)

    halves = F.greatest(F.ceil(F.col("total") / HALF_SHINGLES), F.ceil(F.col("m") / HALF_SETS)).cast("long")
    dealt = many.withColumn("c", halves).withColumn("i", F.pmod(F.xxhash64("set_id"), F.col("c")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).where("c = 1 or i != j")
    block = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "set_id").join(x.hint("merge"), "set_id")
    return found.unionByName(block.groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long"))
