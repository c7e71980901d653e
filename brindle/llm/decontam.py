"""Benchmark decontamination by spaced seeds.

A mask looks at five words of a window and ignores the others, so a hit
survives substitutions at the ignored places. Windows of the benchmark under
every mask are hashed, and so are those of each document; the hashes are joined.
Around a hit the words are compared along its diagonal, and close diagonals of
one item, which insertions and deletions make, count together.

Items too short for the masks have one window of their own length, and count
where a text holds all their words in order.

Documents go through once, whatever the benchmark's size: a Bloom filter of its
seeds, of bounded size, leaves the windows that may have a partner, and only
these windows and the words of their documents go into the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fixed_places, map_arrow, texts, unused

#: Places of a window that count (fixed values).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 8))
#: Bits of the filter for each seed, and the most bits in all, as powers of 2.
FILTER_SHARE, FILTER_MOST = 7, 28
PROBES = 3
#: Items of fewer words must occur whole and in order.
LEAST_WORDS = 8
#: Words that must agree: this many, or this share of a shorter item.
NEED_WORDS, NEED_SHARE = 13, 0.7
#: Diagonals this close belong to one overlap.
DRIFT = 4
#: In scripts without spaces every sign is a word, and so many times as many must agree.
NEED_SIGNS = 3
#: Most places of overlapping documents that are broadcast, 8 bytes each; more are joined.
SENT = 200_000
CACHE = 50_000
#: Pairs of a seed's places, and cells of words on diagonals, that are held at once.
PAIRS, CELLS = 1 << 20, 1 << 21
#: So many seeds, some 60 bytes each, are broadcast; more are joined by a shuffle.
FEW_SEEDS = 200_000
#: Items of a task: many small tasks would each keep a worker.
ITEMS = 20_000
#: Words whose windows are hashed at once.
_GROUP = 200_000
#: Signs of Chinese, Japanese, Thai, Lao, Burmese, Khmer and Tibetan, which put no spaces between words.
_SIGN = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_WORD = re.compile(r"[\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

_words: dict[str, int] = {}


def _hash(chunk: str) -> int:
    """Signed hash of a chunk's letters and digits; 0 if it has none."""
    w = _WORD.sub("", chunk.lower())
    return (xxhash.xxh64_intdigest(w) >> 1) | 1 if w else 0


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, case and punctuation aside; in scripts without spaces every sign is a word."""
    if not text.isascii() and _SIGN.search(text):
        text = _SIGN.sub(r" \g<0> ", text)
    chunks = text.split()
    got = list(map(_words.get, chunks))
    if None in got:
        if len(_words) >= CACHE:
            _words.clear()
        for k, x in enumerate(got):
            if x is None:
                c = chunks[k]
                got[k] = x = _hash(c)
                if len(c) <= 64:
                    _words[c] = x
    a = np.array(got, np.int64)
    return a if a.all() else a[a != 0]


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of every window under a mask."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = words.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k, at in enumerate(mask):
        h = (h ^ w[at : at + n]) * _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(29)
    return h


def _windows(words: np.ndarray, masks: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(mask, its reach, hashes of all windows); a mask of -n stands for n words in a row."""
    for m in masks:
        places = MASKS[m] if m >= 0 else tuple(range(-m))
        yield m, places[-1], _seeds(words, places).view(np.int64)


def _items(benchmark: DataFrame) -> DataFrame:
    """The benchmark's items with a word, each once: item, item_id, need, n, words as bytes, and seeds with their places, by mask and hash."""
    key, kind = unused(benchmark, "item"), benchmark.schema["item_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, cols = [], ([], [], [], [])
        for k, text in enumerate(texts(b)):
            w = word_hashes(text)
            if not len(w):
                continue
            signs = 2 * len(_SIGN.findall(text)) > len(w)
            masks = [*range(len(MASKS))] if len(w) >= LEAST_WORDS else [-len(w)]
            keep.append(k)
            need = min(NEED_WORDS * (NEED_SIGNS if signs else 1), int(np.ceil(NEED_SHARE * len(w))))
            for c, v in zip(cols, (need, len(w), w.tobytes(), _grouped(_windows(w, masks))), strict=True):
                c.append(v)
        rows = pa.array(keep, pa.int64())
        made = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), _HITS), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(key).take(rows), b.column("item_id").take(rows), *made], names=["item", "item_id", "need", "n", "words", "seeds"])

    rows = cut(benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct().withColumn(key, F.monotonically_increasing_id()))
    rows = rows.coalesce(rows.count() // ITEMS + 1)
    return cut(map_arrow(rows, run, f"item long, item_id {kind}, need int, n int, words binary, seeds {_HITS_SQL}"))


_HITS = pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("at", pa.list_(pa.int32()))]))
_HITS_SQL = "array<struct<mask: int, hash: bigint, at: array<int>>>"


def _grouped(windows: Iterator[tuple[int, int, np.ndarray]]) -> list[dict]:
    """Hashes by mask with all their places."""
    out = []
    for m, _, h in windows:
        order = np.argsort(h, kind="stable")
        cuts = np.flatnonzero(np.diff(h[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            out.append({"mask": m, "hash": int(h[at[0]]), "at": at.astype(np.int32)})
    return out


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of hashes in a filter of 2^bits bits."""
    u = h.view(np.uint64)
    for k in range(PROBES):
        yield ((u * _MIX[k]) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(items: DataFrame) -> tuple[np.ndarray, int, dict[int, int]]:
    """The Bloom filter of all seeds, its bits as a power of 2, and the number of seeds of each mask in use. The bits are gathered as words of 64 by the executors."""
    seeds = items.select(F.explode("seeds").alias("s")).select("s.mask", "s.hash").distinct()
    counts = {r.mask: r["count"] for r in seeds.groupBy("mask").count().collect()}  # a few masks
    bits = min(FILTER_MOST, max(10, (sum(counts.values()) << FILTER_SHARE).bit_length()))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.concatenate([np.zeros(0, np.int64), *_probes(b.column("hash").to_numpy(), bits)])
        return pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).cast(pa.int64(), safe=False)], names=["word", "bit"])

    words = map_arrow(seeds.select("hash").coalesce(sum(counts.values()) // PAIRS + 1), run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out, bits, counts


def _candidates(docs: DataFrame, items: DataFrame, extra: list[str]) -> DataFrame:
    """A row for each document and item that share a seed: item, the extra columns of docs, and `hits`, the places of each seed in both."""
    spark = docs.sparkSession
    found, bits, counts = _filter(items)
    masks = sorted(counts)
    sent = spark.sparkContext.broadcast(found)  # 2^FILTER_MOST bits at most

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        held = sent.value
        arrays = [word_hashes(t) for t in texts(b)]
        hits: list[list[dict]] = [[] for _ in arrays]
        at = 0
        while at < len(arrays):
            stop, size = at + 1, len(arrays[at])
            while stop < len(arrays) and size + len(arrays[stop]) <= _GROUP:
                size += len(arrays[stop])
                stop += 1
            lengths = [len(a) for a in arrays[at:stop]]
            starts, doc_of, words = np.cumsum([0, *lengths]), np.repeat(np.arange(stop - at), lengths), np.concatenate(arrays[at:stop])
            for m, reach, h in _windows(words, masks):
                k = np.arange(len(h))
                for p in range(PROBES):
                    place = ((h[k].view(np.uint64) * _MIX[p]) >> np.uint64(64 - bits)).astype(np.int64)
                    k = k[(held[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0]
                k = k[doc_of[k] == doc_of[k + reach]]
                order = k[np.lexsort((k, h[k], doc_of[k]))]
                cuts = np.flatnonzero((np.diff(h[order]) != 0) | (np.diff(doc_of[order]) != 0)) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    doc = int(doc_of[part[0]])
                    hits[at + doc].append({"mask": m, "hash": int(h[part[0]]), "at": (part - starts[doc]).astype(np.int32)})
            at = stop
        keep = [k for k, x in enumerate(hits) if x]
        rows = pa.array(keep, pa.int64())
        made = [pa.array([len(arrays[k]) for k in keep], pa.int32()), pa.array([arrays[k].tobytes() for k in keep], pa.binary()), pa.array([hits[k] for k in keep], _HITS)]
        return pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ["row", *extra]), *made], names=["row", *extra, "size", "text_words", "hits"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    part = docs.select("text", F.monotonically_increasing_id().alias("row"), *[F.col(c) for c in extra])
    met = cut(map_arrow(part, run, "row long, " + "".join(f"{c} {kinds[c]}, " for c in extra) + f"size int, text_words binary, hits {_HITS_SQL}"))
    ours = met.select("row", F.explode("hits").alias("h")).select("row", "h.mask", "h.hash", F.col("h.at").alias("at"))
    theirs = items.select("item", F.explode("seeds").alias("s")).select("item", "s.mask", "s.hash", F.col("s.at").alias("place"))
    small = theirs.count() <= FEW_SEEDS
    pairs = ours.join(F.broadcast(theirs) if small else theirs.hint("merge"), ["mask", "hash"]).groupBy("row", "item").agg(F.collect_list(F.struct("at", "place")).alias("hits"))
    least = lambda c: F.array_min(F.transform("hits", lambda x: F.array_min(x[c])))
    most = lambda c: F.array_max(F.transform("hits", lambda x: F.array_max(x[c])))
    both = pairs.join(met.drop("hits").hint("merge"), "row").join(items.drop("seeds"), "item")
    low = F.greatest(F.lit(0), least("at") - most("place"))
    high = F.least(F.col("size"), most("at") - least("place") + F.col("n"))
    return both.withColumn("low", low).withColumn("text_words", F.substring("text_words", F.col("low") * 8 + 1, (high - F.col("low")) * 8))


def _diagonals(hits: list[dict]) -> np.ndarray:
    """Sorted distinct differences of the places of shared seeds, spread PAIRS at a time."""
    found = [np.zeros(0, np.int64)]
    for x in hits:
        at, place = np.array(x["at"], np.int64), np.array(x["place"], np.int64)
        step = max(1, PAIRS // len(place))
        for k in range(0, len(at), step):
            found.append(np.unique(at[k : k + step, None] - place[None]))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found))


def _overlap(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """Words that agree, and where they begin and end in the text, for the best cluster of sorted diagonals; None if too few.

    A cluster is a diagonal and those up to DRIFT behind it; of equal ones the first counts.
    """
    best = None
    step = max(1, CELLS // len(item))
    for at in range(0, len(diagonals), step):
        d = diagonals[at : at + step + DRIFT]
        agree, first, last = _dense(words, item, d)
        n_heads = min(step, len(diagonals) - at)
        got, lo, hi = agree[:n_heads].copy(), first[:n_heads].copy(), last[:n_heads].copy()
        for k in range(1, DRIFT + 1):  # distinct whole numbers: at most DRIFT others are that close
            m = min(n_heads, len(d) - k)
            if m > 0:
                near = d[k : k + m] - d[:m] <= DRIFT
                got[:m] |= agree[k : k + m] & near[:, None]
                lo[:m] = np.where(near, np.minimum(lo[:m], first[k : k + m]), lo[:m])
                hi[:m] = np.where(near, np.maximum(hi[:m], last[k : k + m]), hi[:m])
        n = got.sum(1)
        k = int(np.argmax(n))
        if n[k] >= need and (best is None or n[k] > best[0]):
            best = int(n[k]), int(lo[k]), int(hi[k])
    return best


def _dense(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each diagonal the item's words that agree inside its best stretch, and the stretch's place in the text.

    In the best stretch an agreeing word counts 1 and any other -2; without an agreeing word it is empty.
    """
    at = diagonals[:, None] + np.arange(len(item))
    same = (at >= 0) & (at < len(words))
    same &= words[np.clip(at, 0, len(words) - 1)] == item
    c = np.zeros((len(diagonals), len(item) + 1), np.int64)
    np.cumsum(np.where(same, 1, -2), axis=1, out=c[:, 1:])
    gain = c - np.minimum.accumulate(c, 1)
    row = np.arange(len(diagonals))
    end = gain.argmax(1)
    some = gain[row, end] > 0
    place = np.arange(len(item) + 1)
    low = c[row, end] - gain[row, end]
    start = np.where((c == low[:, None]) & (place <= end[:, None]), place, 0).max(1)
    inside = (place[:-1] >= start[:, None]) & (place[:-1] < end[:, None]) & some[:, None]
    return same & inside, np.where(some, start + diagonals, len(words)), np.where(some, end + diagonals, 0)


def _best(words: np.ndarray, low: int, item: np.ndarray, need: int, hits: list[dict]) -> tuple[int, int, int] | None:
    """Agreeing words, first word and end of an item's best overlap with a text, of which `words` begins at word `low`."""
    if len(item) < LEAST_WORDS:
        first = min(min(x["at"]) for x in hits)
        return len(item), first, first + len(item)
    got = _overlap(words, item, _diagonals(hits) - low, need)
    return got and (got[0], got[1] + low, got[2] + low)


def contaminated(docs: DataFrame, benchmark: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, n_agree, item_words, first_word, end_word.

    Null and empty texts overlap nothing; repeated documents come back
    repeated, repeated benchmark rows count once, and an item without an id has
    a null item_id; an empty table on either side gives an empty result; other
    columns are ignored, save those named as `extra`, which stand in for doc_id.
    Of equally good overlaps the first is reported. Whole texts are compared, and
    words that repeat without end cost time in proportion to the text times the
    item, not memory. Ids may be of any type.
    """
    extra = extra or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    item_kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, out = [], ([], [], [])
        for k, (w, low, item, need, hits) in enumerate(zip(*(b.column(c) for c in ("text_words", "low", "words", "need", "hits")), strict=True)):
            words, own = (np.frombuffer(x.as_buffer(), np.int64) for x in (w, item))
            if got := _best(words, low.as_py(), own, need.as_py(), hits.as_py()):
                keep.append(k)
                for c, v in zip(out, got, strict=True):
                    c.append(v)
        rows = pa.array(keep, pa.int64())
        same = [b.column(c).take(rows) for c in (*extra, "item_id")]
        agree, first, end = (pa.array(c, pa.int32()) for c in out)
        return pa.RecordBatch.from_arrays([*same, agree, b.column("n").take(rows), first, end], names=[*extra, "item_id", "n_agree", "item_words", "first_word", "end_word"])

    schema = "".join(f"{c} {kinds[c]}, " for c in extra) + f"item_id {item_kind}, n_agree int, item_words int, first_word int, end_word int"
    return map_arrow(cut(_candidates(docs, _items(benchmark), extra).select(*extra, "item_id", "text_words", "low", "words", "need", "n", "hits")), run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns: null and empty texts and repeated rows stay, an empty table stays empty.

    Texts move only where more than SENT documents overlap.
    """
    if not fixed_places(docs):
        docs = cut(docs)  # a row must be found at its place again
    at = unused(docs, "__place")
    tagged = docs.withColumn(at, F.monotonically_increasing_id())
    leaks = cut(contaminated(tagged, benchmark, [at]).select(at).distinct())
    return tagged.join(F.broadcast(leaks) if leaks.count() <= SENT else leaks.hint("merge"), at, "left_anti").drop(at)
