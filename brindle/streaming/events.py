"""Structured Streaming operators. All also run on a batch DataFrame, where a watermark has no effect."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A snapshot of a folder and all below it: path, length, modified. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to a folder between two listings: op (add, remove, modify or rename), path, old_path.

    A file that went and one that came with the same length and time, neither of
    them with a double, are a rename.
    """
    b, a = (x.select(F.col("path").alias(f"{n}p"), F.struct("length", "modified").alias(f"{n}s")) for x, n in ((before, "b"), (after, "a")))
    both = b.join(a, F.col("bp") == F.col("ap"), "full_outer")
    modified = both.where("bp IS NOT NULL AND ap IS NOT NULL AND bs != `as`").select(F.lit("modify").alias("op"), F.col("ap").alias("path"), F.lit(None).cast("string").alias("old_path"))
    one = both.where("bp IS NULL OR ap IS NULL").withColumn("k", F.coalesce("bs", "as"))
    moves = one.groupBy("k").agg(F.count("bp").alias("nb"), F.count("ap").alias("na"), F.collect_list("bp").alias("was"), F.collect_list("ap").alias("now"))
    single = (F.col("nb") == 1) & (F.col("na") == 1)
    renamed = moves.where(single).select(F.lit("rename").alias("op"), F.col("now")[0].alias("path"), F.col("was")[0].alias("old_path"))
    rest = moves.where(~single)
    added = rest.select(F.lit("add").alias("op"), F.explode("now").alias("path"), F.lit(None).cast("string").alias("old_path"))
    removed = rest.select(F.lit("remove").alias("op"), F.explode("was").alias("path"), F.lit(None).cast("string").alias("old_path"))
    return modified.unionByName(renamed).unionByName(added).unionByName(removed)


def by_type(df: DataFrame, column: str, *kinds: str) -> DataFrame:
    """Messages of some types."""
    return df.filter(F.col(column).isin(*kinds))


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], late: str | None = None, slide: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates by time window: start, end, keys, aggregates; late rows beyond the watermark are left out of a stream."""
    src = df.withWatermark(ts, late) if late else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    got = src.groupBy(w.alias("__w"), *by).agg(*[a.alias(n) for n, a in aggs.items()])
    return got.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates by session: rows of a key with less than `gap` between neighbours."""
    src = df.withWatermark(ts, late) if late else df
    got = src.groupBy(F.session_window(ts, gap).alias("__w"), *by).agg(*[a.alias(n) for n, a in aggs.items()])
    return got.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *by, *aggs)


def first_seen(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """One row of each key within the watermark's span; in a table, one of each key."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def fan_out(df: DataFrame, sinks: list[tuple[int, Callable[[DataFrame, int], None]]], checkpoint: str):
    """Start a stream that hands every micro-batch to all sinks, those of higher priority first."""
    ordered = [f for _, f in sorted(sinks, key=lambda s: -s[0])]

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for f in ordered:
                f(batch, epoch)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def latest(df: DataFrame, key: str, op: str, value: str, order: str) -> DataFrame:
    """The state of a change feed by key: the value of the last change, keys last removed left out. op is put or delete."""
    last = df.groupBy(key).agg(F.max_by(F.struct(op, value), F.col(order)).alias("__l"))
    return last.where(F.col(f"__l.{op}") != "delete").select(key, F.col(f"__l.{value}").alias(value))


def kalman(df: DataFrame, key: str, ts: str, value: str, process: float, noise: float) -> DataFrame:
    """Constant-level Kalman filter for each key of a stream: key, ts, estimate, variance for every row, in order within a micro-batch."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(ts)
        x, p = state.get if state.exists else (None, None)
        est, var = [], []
        for z in rows[value].to_numpy(float):
            if x is None:
                x, p = z, noise
            else:
                p += process
                gain = p / (p + noise)
                x, p = x + gain * (z - x), (1 - gain) * p
            est.append(x)
            var.append(p)
        if x is not None:
            state.update((x, p))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts].to_numpy(), "estimate": est, "variance": var})

    return df.select(key, ts, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {ts} {kinds[ts]}, estimate double, variance double", "x double, p double", "append", GroupStateTimeout.NoTimeout)
