"""SimHash near-duplicate groups, with candidates from pigeonring chains.

A fingerprint of 64 bits is four segments of 16 on a ring. If two fingerprints
differ in at most 3 bits, some segment starts a chain in which the first k
segments differ in at most 3k/4 bits together, for every k: 0, then 1, 2 and 3.
The first two links of the chain are one equi-join on 32 bits: each fingerprint
is indexed under its own two segments, and looks up itself and every form with
one set bit of the second segment cleared. The third link and the full
distance are checked on the joined pair.

Where many different fingerprints share 32 bits, pairs would grow with the
square of their number. There every fingerprint instead names the points
within 1 and 2 bits of its other half, and all that meet at a point are linked
to one of those within 1 bit of it. Every such link is within 3 bits, every
pair within 3 bits meets at a point, and a point has boundedly many members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components
from . import shingles
from .common import cut, fixed_places, map_arrow, raw, unused

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Indexed fingerprints under one key above which they meet at points instead of pairwise.
CROWD = 24
#: Most places of dropped rows that are broadcast, 8 bytes each; more are joined.
SENT = 200_000
_BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Majority bits over the hashes of a text's 3-word shingles, as an unsigned number; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + SHINGLE - 1]
        if len(words) < SHINGLE:
            h = [digest(b" ".join(part), SEED)]
        else:
            h = [digest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])]
        view = np.array(h, "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(view, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash of every whole text; a null text counts as empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in raw(b)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), b.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return map_arrow(part, run, f"doc_id {kind}, fp long, text_hash long")


def _prints_and_sets(docs: DataFrame) -> DataFrame:
    """As fingerprints, and the row's place; of each text's set of 5-word shingles the id, the size n and the band keys."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(b)
        fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        sets = [shingles.shingles(t) for t in texts]
        more = [pa.array([shingles.set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([shingles.bands(x) for x in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), b.column("text_hash"), b.column("place"), *more], names=["doc_id", "fp", "text_hash", "place", "set_id", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    return map_arrow(part, run, f"doc_id {kind}, fp long, text_hash long, place long, set_id long, n long, keys array<long>")


def _similar(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints of texts whose 5-word shingles are similar or the same."""
    sets = cut(prints.where("n > 0").dropDuplicates(["set_id"]).select("set_id", "n", "fp", "keys"))
    of = sets.select("set_id", F.col("fp").alias("own"))
    same = prints.where("n > 0").select("set_id", "fp").distinct().join(of.hint("merge"), "set_id").select(F.col("fp").alias("u"), F.col("own").alias("v"))
    pairs = cut(shingles.similar(docs, sets.select("set_id", "n", "keys")))
    a, b = of.toDF("a", "u"), of.toDF("b", "v")
    linked = cut(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("u", "v").distinct(), pairs)
    return same.unionByName(linked).where("u != v").distinct()


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def _entries(fp: Column) -> list[tuple[Column, Column, Column]]:
    """For each start on the ring: the key of its first two segments, the second segment, and the other half."""
    out = []
    for i in range(4):
        a, b, c, d = (_segment(fp, i + k) for k in range(4))
        key = F.lit(i << 32).bitwiseOR(F.shiftleft(a, 16)).bitwiseOR(b)
        out.append((key, b, F.shiftleft(c, 16).bitwiseOR(d)))
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose transitive closure is that of all pairs within DISTANCE bits.

    fps has one column fp without repeats. Where no key is crowded nothing meets
    at points; else pairs and points are written apart, each by a plan of its own.
    Joins are merges by hint: exploded rows are many times what Spark takes them
    for, and broadcasting them would fill the driver.
    """
    fp = F.col("fp")
    index = fps.select("fp", F.explode(F.array(*[F.struct(k.alias("key"), r.alias("rest")) for k, _, r in _entries(fp)])).alias("e")).select("fp", "e.key", "e.rest")
    bit = F.lit(1).cast("long")

    def cleared(b: Column) -> Column:
        ones = F.filter(F.array(*[F.lit(1 << j).cast("long") for j in range(16)]), lambda m: b.bitwiseAND(m) != 0)
        return F.concat(F.array(F.lit(0).cast("long")), ones)

    probe = fps.select("fp", F.explode(F.array(*[F.struct(k.alias("key"), r.alias("rest"), cleared(b).alias("flips")) for k, b, r in _entries(fp)])).alias("e"))
    probe = probe.select("fp", "e.key", "e.rest", F.explode("e.flips").alias("flip")).select("fp", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "rest", "flip")
    crowded = cut(index.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    any_crowd = not crowded.isEmpty()

    # pairwise, at most CROWD for each look-up
    few = (index.join(crowded.hint("merge"), "key", "left_anti") if any_crowd else index).select("key", F.col("fp").alias("a"))
    differ = F.col("a").bitwiseXOR(F.col("fp"))
    start = F.shiftright("key", 32).cast("int")
    chain = [F.bit_count(_segment(differ, i + 1)) + F.bit_count(_segment(differ, i + 2)) for i in range(4)]
    third = F.when(start == 0, chain[0]).when(start == 1, chain[1]).when(start == 2, chain[2]).otherwise(chain[3])
    p = probe.select(F.col("key").alias("k"), "fp", "flip")
    near = (F.col("key") == F.col("k")) & ((F.col("flip") != 0) | (F.col("a") < F.col("fp"))) & (third <= 2) & (F.bit_count(differ) <= DISTANCE)
    pairs = few.join(p.hint("merge"), near).select(F.greatest("a", "fp").alias("u"), F.least("a", "fp").alias("v")).distinct()
    if not any_crowd:
        return pairs
    pairs = cut(pairs)

    # at points of the other half
    one = [0, *[1 << j for j in range(32)]]
    two = [(1 << i) | (1 << j) for i, j in combinations(range(32), 2)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    own = index.join(crowded.hint("merge"), "key", "left_semi")
    seen = F.explode(F.concat(F.transform(lits(one), lambda m: F.struct(m.alias("m"), F.lit(1).alias("hub"))), F.transform(lits(two), lambda m: F.struct(m.alias("m"), F.lit(0).alias("hub")))))
    at = own.select("key", "fp", "rest", seen.alias("s")).select("key", F.col("rest").bitwiseXOR(F.col("s.m")).alias("point"), "fp", F.col("s.hub").alias("hub"))
    other = probe.where(F.col("flip") != 0).join(crowded.hint("merge"), "key", "left_semi").select("key", "fp", "rest", F.explode(lits(one)).alias("m")).select("key", F.col("rest").bitwiseXOR(F.col("m")).alias("point"), "fp", F.lit(0).alias("hub"))
    met = at.unionByName(other).groupBy("key", "point").agg(F.min(F.when(F.col("hub") == 1, F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
    stars = met.where(F.col("a").isNotNull() & (F.size("all") > 1)).select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(cut(stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), crowded)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): node and root, its smallest node; nodes without an edge are absent."""
    return star_components(edges)


def _groups(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """fp and its component's root, for every fingerprint; more are links (u, v) besides those within DISTANCE bits."""
    nodes = prints.select("fp").distinct()
    edges = links(nodes)
    roots = components(edges if more is None else edges.unionByName(more))
    return nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Equal fingerprints, and those within DISTANCE bits, are linked; component_id
    is the smallest doc_id reachable. Empty and null texts have fingerprint zero
    and are linked like any other. A null doc_id never becomes a component_id;
    a component of such rows alone has a null one. Very long texts are read
    whole, in blocks. Repeated rows come back repeated, other columns of docs are ignored, and an empty table gives an
    empty result.
    """
    prints = cut(fingerprints(docs))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    group = cut(_groups(prints).join(ids.hint("merge"), "fp"))
    first = group.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = cut(group.join(first.hint("merge"), "root").select("fp", "component_id"))
    return prints.join(of.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with all its columns: the smallest doc_id, rows without one last, then the smallest text hash.

    Linked are texts of fingerprints within DISTANCE bits, as in near_duplicates,
    and all texts whose sets of 5-word shingles have a Jaccard similarity of 0.8
    or more. Texts without words, null ones too, are one group; of repeated rows
    one stays, and an empty table gives an empty result. Groups are decided on
    narrow rows; texts move only where more than SENT rows are dropped.
    """
    if not fixed_places(docs):
        docs = cut(docs)  # a row must be found at its place again
    prints = cut(_prints_and_sets(docs))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("place"))
    ids = prints.groupBy("fp").agg(F.min(key).alias("k"))
    first = cut(_groups(prints, _similar(docs, prints)).join(ids.hint("merge"), "fp").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.place").alias("kept")))
    at = unused(docs, "__place")
    gone = cut(prints.join(first.hint("merge"), F.col("place") == F.col("kept"), "left_anti").select(F.col("place").alias(at)))
    tagged = docs.withColumn(at, F.monotonically_increasing_id())
    return tagged.join(F.broadcast(gone) if gone.count() <= SENT else gone.hint("merge"), at, "left_anti").drop(at)
