"""Large groups and many ranges: the operators that cut them give what the plain ones give."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.operators import joins, ordered, windows

C = F.col


@pytest.fixture(params=["literal", "partitioned"])
def many_ranges(request, monkeypatch):
    """Ranges of few rows, as literals of the plan or from range partitioning."""
    for m in (ordered, windows):
        monkeypatch.setattr(m, "RANGE_ROWS", 40)
    monkeypatch.setattr(windows, "BLOCK_ROWS", 25)
    if request.param == "partitioned":
        monkeypatch.setattr(ordered, "MAX_RANGES", 2)


@pytest.fixture(scope="module")
def skewed(spark):
    """Nine tenths of the rows have one key; null keys and ties occur."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot"] * 18 + ["a", None]), rng.randint(0, 150), float(rng.randint(0, 40))) for k in range(400)]
    return rows, spark.createDataFrame(rows, "id int, g string, t int, v double").repartition(3).cache()


def test_ordinals(spark, skewed, many_ranges):
    rows, df = skewed
    order = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r.id: r.ord for r in ordered.with_ordinal(df, ["t", "id"]).collect()} == order
    want, seen = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want[r[0]] = seen[r[1]]
        seen[r[1]] += 1
    assert {r.id: r.n for r in ordered.with_ordinal(df, ["t", "id"], "n", by=["g"]).collect()} == want


def test_as_of_in_groups(spark, skewed, many_ranges):
    rows, df = skewed
    keys = df.where("v > 35").select(C("g").alias("g"), C("t").alias("k"))
    held = [(r[1], r[2]) for r in rows if r[3] > 35]
    for strict in (False, True):
        down = {r.id: r.bound for r in joins.as_of(df, keys.withColumnRenamed("k", "kk"), "t", "kk", by=["g"], strict=strict).collect()}
        up = {r.id: r.bound for r in joins.lower_bound(df, keys.withColumnRenamed("k", "kk"), "t", "kk", by=["g"], strict=strict).collect()}
        for i, g, t, _ in rows:
            assert down[i] == max((k for h, k in held if h == g and (k < t or (k == t and not strict))), default=None)
            assert up[i] == min((k for h, k in held if h == g and (k > t or (k == t and not strict))), default=None)


def test_windows_in_blocks(spark, skewed, many_ranges):
    rows, df = skewed
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    mean = {r.id: r["mean"] for r in windows.moving_average(df, "v", ["g"], ["t", "id"], 7).collect()}
    taps = [0.25, 0.5, 0.125, 0.125]
    filtered = {r.id: r.filtered for r in windows.fir(df, "v", taps, ["g"], ["t", "id"]).collect()}
    stamped = df.withColumn("ts", F.timestamp_seconds("t"))
    rate = {r.id: r.rate for r in windows.frame_rate(stamped, "ts", ["g"], ["t", "id"], 3).collect()}
    assert len(mean) == len(filtered) == len(rate) == len(rows)
    for some in groups.values():
        for k, r in enumerate(some):
            part = [x[3] for x in some[max(0, k - 6) : k + 1]]
            assert mean[r[0]] == pytest.approx(sum(part) / len(part))
            assert filtered[r[0]] == pytest.approx(sum(t * some[min(max(k + i - 2, 0), len(some) - 1)][3] for i, t in enumerate(taps)))
            span = r[2] - some[k - 3][2] if k >= 3 else 0
            assert rate[r[0]] == (pytest.approx(3 / span) if span else None)


def test_far_rows_by_ordinal(spark, skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(ordered, "TOP_ROWS", 10)
    assert [r.id for r in ordered.at(df, 300, ["id"]).collect()] == [300]
    assert sorted(r.id for r in ordered.slice_rows(df, ["id"], -20, -10).collect()) == list(range(380, 390))
    assert ordered.skip(df, 390, ["id"]).count() == 10 and ordered.slice_rows(df, ["id"], 30, 20).count() == 0


def test_running_totals(spark, skewed, many_ranges):
    _, df = skewed
    assert [r.t for r in ordered.upper_median(df, "t", ["t"]).collect()] == [sorted(r[2] for r in skewed[0])[200]]
