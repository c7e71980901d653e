"""What the plans broadcast: no side that grows with the input, however small Spark takes it for."""

import pytest
from pyspark.sql import functions as F

from brindle.llm import simhash
from brindle.operators import graph, joins, windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_links_broadcast_nothing(spark):
    got = simhash.links(spark.range(500).select(F.xxhash64("id").alias("fp")))
    assert "Broadcast" not in plan(got)


def test_points_within_broadcast_nothing(spark):
    p = spark.range(300).select(F.col("id").alias("a"), (F.col("id") % 50).alias("x"), (F.col("id") / 4).alias("y"))
    assert "Broadcast" not in plan(joins.within(p, p.toDF("b", "u", "v"), [("x", "u"), ("y", "v")], 2.0))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_bounds_by_frames_from_the_first_row(spark, by):
    """A frame up to the last row is evaluated anew for each row, in the square of a range's rows."""
    p = spark.range(300).select(F.col("id").alias("t"), (F.col("id") % 3).alias("g"))
    assert "unboundedfollowing" not in plan(joins.lower_bound(p, p.select("g", F.col("t").alias("k")), "t", "k", by)).lower()


def test_scaling_by_few_groups_moves_no_row(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    for got in (windows.zscore(df, "v", ["g"]), windows.rms_scale(df, "v", ["g"])):
        assert "BroadcastHashJoin" in plan(got) and "hashpartitioning" not in plan(got)


def test_small_components_share_a_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_EDGES", 50)
    e = spark.range(200).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst"))
    got = graph.colour(e)
    assert "__part" in plan(got)
    assert {r.node: r.colour for r in got.collect()} == {k: k % 2 for k in range(400)}
