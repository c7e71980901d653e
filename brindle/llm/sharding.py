"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash bits choose its bucket; the directory is indexed by a prefix of
them. Buckets over the byte limit split on the next bit, all others stay, until
every shard fits. STRIDE bits are decided in one pass: sizes of all prefixes of
these bits come from one aggregation of the finest ones, and each row's shard is
its shortest prefix that fits. Only rows in buckets that are still too large
take part in the next pass.

The first 60 bits are those of the key's MD5. Repeated keys share them; their
rows go on splitting by a second hash of key, size and place in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

STRIDE = 12
KEY_BITS = 60
#: Bits after which rows count as inseparable.
DEEPEST = 120
LIMIT = 1 << 20


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int, bits: Column) -> Column:
    """The first `depth` bits of a 60-bit word, as a number."""
    return F.shiftrightunsigned(bits, KEY_BITS - depth) if depth < KEY_BITS else bits


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the two hash words of every row; written once, as all passes must see the same values."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    own = F.concat_ws("/", key, n.cast("string"), F.monotonically_increasing_id().cast("string"))
    return cut(docs.select("doc_id", n.alias("n_bytes"), _hash60(key).alias("h0"), _hash60(own).alias("h1")))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The shard of every row: doc_id, n_bytes, depth, prefix, shard_bytes, shard_rows, fits.

    A shard is (depth, prefix): the first `depth` hash bits, prefix holding them
    as a 0/1 string. Every shard's bytes are at most `limit`, save that a single
    row larger than that is a shard of its own, with fits false. A null text has
    0 bytes, a null doc_id hashes as the empty string, repeated rows are kept
    and split apart by place, a very long text counts with all its bytes, an
    empty table gives an empty result, and other columns are ignored.
    """
    rows = sized(docs)
    left, done = rows.withColumn("path", F.lit("")), None
    for base in range(0, DEEPEST, STRIDE):
        word, at = ("h0", base) if base < KEY_BITS else ("h1", base - KEY_BITS)
        finest = _prefix(at + STRIDE, F.col(word)).bitwiseAND(F.lit((1 << STRIDE) - 1))
        left = left.withColumn("fine", finest)
        sums = left.groupBy("path", "fine").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        per = sums.select("path", "fine", "b", "n", F.explode(F.sequence(F.lit(0 if base == 0 else 1), F.lit(STRIDE))).alias("d"))
        per = per.withColumn("p", F.expr(f"shiftright(fine, {STRIDE} - d)"))
        size = per.groupBy("path", "d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = size.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1))
        chosen = per.join(fits, ["path", "d", "p"]).groupBy("path", "fine").agg(F.min(F.struct("d", "p", "shard_bytes", "shard_rows")).alias("s"))
        directory = cut(sums.select("path", "fine").join(chosen, ["path", "fine"], "left").select("path", "fine", "s"))
        joined = left.join(directory, ["path", "fine"])
        bits = F.lpad(F.bin("s.p"), F.col("s.d"), "0")
        here = joined.where("s is not null").select("doc_id", "n_bytes", (F.col("s.d") + base).alias("depth"), F.concat("path", F.when(F.col("s.d") == 0, "").otherwise(bits)).alias("prefix"), "s.shard_bytes", "s.shard_rows")
        done = here if done is None else done.unionByName(here)
        if directory.where("s is null").isEmpty():
            return done.withColumn("fits", F.col("shard_bytes") <= limit)
        left = cut(joined.where("s is null").select("doc_id", "n_bytes", "h0", "h1", F.concat("path", F.lpad(F.bin("fine"), STRIDE, "0")).alias("path")))
    raise RuntimeError(f"buckets over {limit} bytes after {DEEPEST} hash bits")


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write docs by shard, one folder each.

    Rows of one id and size are dealt one to one over its assignments, so
    repeated rows stay as many and each shard gets the bytes assigned to it.
    Rows reach a shard's files by its name, so no task holds more than some
    shards; only rows of one id and size are numbered together.
    """
    id_, size, nth = (unused(docs, n) for n in ("__id", "__size", "__nth"))
    at = Window.partitionBy(id_, size)
    named = shards.select(F.col("doc_id").alias(id_), F.col("n_bytes").alias(size), F.concat(F.lit("s"), "prefix").alias("shard"))
    named = named.withColumn(nth, F.row_number().over(at.orderBy("shard")))
    rows = docs.withColumns({id_: F.col("doc_id"), size: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    rows = rows.withColumn(nth, F.row_number().over(at.orderBy(F.xxhash64("text"))))
    one = F.col(f"d.{id_}").eqNullSafe(F.col(f"s.{id_}")) & (F.col(f"d.{size}") == F.col(f"s.{size}")) & (F.col(f"d.{nth}") == F.col(f"s.{nth}"))
    whole = rows.alias("d").join(named.alias("s"), one).select(*[F.col(f"d.`{c}`") for c in docs.columns], "s.shard")
    whole.repartition("shard").write.partitionBy("shard").parquet(path)


#: The same assignment in DuckDB, for tables whose doc_ids are unique and whose shards need at most 16 bits.
SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) n, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT h FROM documents),
k AS (SELECT unnest(range(0, 25))::INT depth),
s AS (SELECT depth, h >> (60 - depth) p, sum(n)::BIGINT shard_bytes, count(*) shard_rows FROM d, k GROUP BY 1, 2),
c AS (SELECT d.doc_id, d.n n_bytes, d.h, s.depth, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) r
      FROM d, s WHERE s.p = d.h >> (60 - s.depth) AND (s.shard_bytes <= {LIMIT} OR s.shard_rows <= 1))
SELECT doc_id, n_bytes::BIGINT n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h), 60, '0')[1:depth], depth) END prefix, shard_bytes, shard_rows, shard_bytes <= {LIMIT} fits
FROM c WHERE r = 1
"""
