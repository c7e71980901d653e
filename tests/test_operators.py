"""Edge cases, fixtures and algebraic laws of the core operators."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators import aggregates, graph, joins, ordered, rows, sets, windows
from brindle.plans.pipeline import Query, stage

C = F.col
quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def vals(df, c=0):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def x(spark):
    return rows.int_range(spark, 100)


@pytest.fixture(scope="module")
def table1(spark):
    return spark.createDataFrame(list(zip("abcdefg", "one two three four five six seven".split())), "a string, b string")


@pytest.fixture(scope="module")
def table2(spark):
    return spark.createDataFrame([("g", 7), ("a", 1), ("b", 2), ("e", 5), ("d", 4), ("f", 6)], "a2 string, n int")


def test_chained_where(x):
    assert sorted(vals(rows.where(rows.where(x, C("x") % 3 == 0), C("x") < 50))) == list(range(0, 50, 3))


def test_transform_and_average(x):
    tens = rows.transform(x, t=F.floor(C("x") / 10))
    assert Counter(vals(tens)) == {k: 10 for k in range(10)}
    d = tens.distinct()
    assert d.agg(aggregates.average(C("t")), aggregates.average(C("t"), truncate=True)).first()[:] == (4.5, 4)


def test_concat_first_and_join(table1, table2):
    both = Query(table1.select("a"), ["a"]).concat(Query(table2.select(C("a2").alias("a")), ["a"]))
    assert both.df.count() == 13 and both.first().first()["a"] == "a"
    j = Query(table1, ["a"]).join(Query(table2, ["a2"]), [("a", "a2")])
    assert vals(j.result().select("n")) == [1, 2, 4, 5, 6, 7]


def test_order_by_descending(x):
    q = Query(x, ["x"]) | (stage("where", C("x") % 3 == 0) | stage("order_by", "x", True))
    assert vals(q.result()) == list(range(99, -1, -3))
    assert q.first().first()[0] == 99 and q.last().first()[0] == 0
    assert vals(q.skip(30).result()) == [9, 6, 3, 0]
    assert vals(q.take_while(C("x") > 90).result()) == [99, 96, 93]


def test_skip_and_take_edges(x):
    for n, want in ((0, 100), (1, 99), (99, 1), (100, 0), (500, 0)):
        assert ordered.skip(x, n, ["x"]).count() == want
    assert ordered.take(x, 0, ["x"]).count() == 0
    assert ordered.skip_while(x, C("x") >= 0, ["x"]).count() == 0
    assert ordered.take_while(x, C("x") >= 0, ["x"]).count() == 100
    assert ordered.take_while(x, C("x") > 0, ["x"]).count() == 0
    assert ordered.skip_while(x, F.lit(None).cast("boolean"), ["x"]).count() == 100
    none = x.where("x < 0")
    assert ordered.skip_while(none, C("x") > 0, ["x"]).count() == 0


def test_elements(x):
    assert ordered.at(x, 5, ["x"]).first()[0] == 5 and ordered.at(x, 500, ["x"]).count() == 0
    assert ordered.at_or_default(x, 500, ["x"], x=-1).first()[0] == -1
    assert ordered.last_or_default(x, ["x"], x=-1).first()[0] == 99
    assert ordered.single(x.where("x = 3")).first()[0] == 3
    assert ordered.single_or_default(x, x=-7).first()[0] == -7
    with pytest.raises(Exception, match="exactly one"):
        ordered.single(x).collect()
    assert vals(ordered.slice_rows(x, ["x"], -5, -2)) == [95, 96, 97]
    assert vals(ordered.slice_rows(x, ["x"], 3, 6)) == [3, 4, 5]
    assert ordered.upper_median(x, "x", ["x"]).first()[0] == 50


def test_ordinals_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 7)
    rng = np.random.default_rng(42)
    v = [int(i) for i in rng.integers(0, 30, 200)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(v)] + [(200, None)], "i long, a long")
    got = {r["i"]: r["ord"] for r in ordered.with_ordinal(df, ["a", "i"]).collect()}
    want = sorted(range(201), key=lambda i: (i < 200, v[i] if i < 200 else 0, i))
    assert [got[i] for i in want] == list(range(201))
    assert ordered.upper_median(df, "a", ["i"]).first()[0] == sorted(v)[100]


def test_as_of_by_ranges(spark, monkeypatch):
    keys = [3, 7, 7, 20, 41]
    df, k = spark.range(50).toDF("t"), spark.createDataFrame([(a,) for a in keys], "k long")
    for limit in (10_000, 5):
        monkeypatch.setattr(ordered, "RANGE_ROWS", limit)
        for strict in (False, True):
            low = {r["t"]: r["bound"] for r in joins.lower_bound(df, k, "t", "k", strict=strict).collect()}
            back = {r["t"]: r["bound"] for r in joins.as_of(df, k, "t", "k", strict=strict).collect()}
            for t in range(50):
                assert low[t] == min((a for a in keys if a > t or (a == t and not strict)), default=None)
                assert back[t] == max((a for a in keys if a < t or (a == t and not strict)), default=None)


@quick
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_bag_laws(spark, a, b):
    da, db = (spark.createDataFrame([(i,) for i in s], "k int") for s in (a, b))
    ca, cb = Counter(a), Counter(b)
    read = lambda df: {r["k"]: r["n"] for r in df.collect()}
    assert read(sets.bag_sum(da, db)) == dict(ca + cb)
    assert read(sets.bag_difference(da, db)) == dict(ca - cb)
    assert read(sets.bag_intersection(da, db)) == dict(ca & cb)
    assert read(sets.bag_max(da, db)) == dict(ca | cb)
    assert read(sets.bag_intersection(da, da)) == read(sets.bag_max(da, da)) == dict(ca) and not read(sets.bag_difference(da, da))
    assert sorted(vals(sets.expand(sets.counts(da)))) == sorted(a)
    assert set(vals(sets.symmetric_difference(da, db))) == set(a) ^ set(b)
    assert sets.compare_sets(da, db).first()["subset"] == (set(a) <= set(b))
    assert sets.compare_bags(da, db).first()["sub_bag"] == all(cb[k] >= n for k, n in ca.items())


@quick
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=10), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=10), st.integers(1, 9))
def test_interval_overlap(spark, a, b, width):
    da = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "ai int, al int, ah int")
    db = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "bi int, bl int, bh int")
    got = sorted((r["ai"], r["bi"]) for r in joins.interval_overlap(da, db, "al", "ah", "bl", "bh", width).collect())
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if not (q[1] < p[0] or p[1] < q[0]) and max(min(p), min(q)) <= min(max(p), max(q)))
    assert got == want


def test_interval_overlap_merges_and_keeps_partners_together(spark):
    da = spark.range(40).selectExpr("id", "id % 7 AS lo", "id % 7 + 3 AS hi")
    db = spark.range(50).selectExpr("id", "id % 11 AS from", "id % 11 + 2 AS to")
    got = joins.interval_overlap(da, db, "lo", "hi", "from", "to", 4)
    assert got.columns == ["id", "lo", "hi", "id", "from", "to"]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((a, a % 7, a % 7 + 3, b, b % 11, b % 11 + 2) for a in range(40) for b in range(50) if a % 7 <= b % 11 + 2 and b % 11 <= a % 7 + 3)
    runs = 1 + sum(x[3] != y[3] for x, y in zip(rows, rows[1:]))
    assert runs <= 2 * 50  # a right row touches two cells at most


def test_last_wins_and_semi_keep_duplicates(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (3, "z", 2)], "k2 int, v string, o int")
    assert vals(joins.lookup(left, right, [("k", "k2")], ["o"]).select("v")) == ["y", "y"]
    assert len(vals(joins.semi(left, right, [("k", "k2")]))) == 2
    assert sorted(vals(joins.anti(left, right, [("k", "k2")])), key=str) == [2, None]


def test_empty_folds(x):
    none = x.where("x < 0")
    got = none.agg(aggregates.total(C("x")).alias("s"), aggregates.all_of(C("x") > 0).alias("all"), aggregates.any_of(C("x") > 0).alias("any"), aggregates.none_of(C("x") > 0).alias("none"), aggregates.contains(C("x"), 1).alias("has")).first()
    assert (got.s, got["all"], got["any"], got["none"], got.has) == (0, True, False, True, False)
    w = x.agg(*[c.alias(n) for n, c in aggregates.weighted(C("x"), F.lit(2.0)).items()]).first()
    assert abs(w.mean - 49.5) < 1e-9
    assert aggregates.fold(x, [], "x", ["x"], F.lit("").cast("string"), lambda a, v: F.concat(a, v.cast("string"))).first()[0].startswith("0123")


def test_extent_zero_scales(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "g string, v double")
    assert vals(windows.minmax_scale(df, "v", ["g"]).select("scaled")) == [0.0, 0.0]
    assert vals(windows.zscore(df, "v", ["g"]).select("z")) == [None, None]


def test_box_average_and_point_sample(spark, x):
    cells = spark.createDataFrame([(i, j, float(i * 3 + j)) for i in range(3) for j in range(3)], "i int, j int, v double")
    got = {(r.i, r.j): r.mean for r in windows.box_average(cells, 3, 3).collect()}
    assert abs(got[1, 1] - 4.0) < 1e-9 and abs(got[0, 0] - 2.0) < 1e-9
    assert sorted(vals(windows.point_sample(x, 25, ["x"]))) == [0, 25, 50, 75]


def test_nearest_ties(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0]), (4, None)], "pid long, v array<double>")
    q = spark.createDataFrame([(9, [0.1, 0.0]), (8, [5.0, 4.0]), (7, None), (1, [0.0, 0.0])], "qid long, v array<double>")
    got = {r.qid: (r.pid, round(r.dist2, 6)) for r in joins.nearest(q, p, "v", "qid", "pid", "v").collect()}
    assert got == {9: (1, 0.01), 8: (3, 1.0), 1: (1, 0.0)}
    assert {r.qid: r.pid for r in joins.nearest(q, p, "v", "qid", "pid", "v", other=True).collect()}[1] == 2
    assert {r.qid for r in joins.nearest(q, p, "v", "qid", "pid", "v", most=0.5).collect()} == {9, 1}
    assert joins.nearest(q, p.where("false"), "v", "qid", "pid", "v").count() == 0 == joins.nearest(q.where("false"), p, "v", "qid", "pid", "v").count()


@pytest.mark.parametrize("pivots,cell", [(1, 7), (5, 20), (40, 3), (9, 1000)])
def test_nearest_by_brute_force(spark, monkeypatch, pivots, cell):
    monkeypatch.setattr(joins, "PIVOTS", pivots)
    monkeypatch.setattr(joins, "CELL_ROWS", cell)
    rng = np.random.default_rng(pivots)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, v array<double>").repartition(3)
    got = {r.qid: (r.pid, r.dist2) for r in joins.nearest(p.toDF("qid", "v"), p, "v", "qid", "pid", "v", other=True).collect()}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == (int(d.argmin()), d.min())


def test_graph_routines(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (8, 9, 2.0), (4, 5, 1.0), (2, 5, 9.0)], "src long, dst long, w double")
    comp = {r.node: r.component for r in graph.connected_components(e, spark.createDataFrame([(77,)], "n long")).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 77: 77}
    dist = {r.node: r.dist for r in graph.shortest_paths(e, 1).collect()}
    assert dist == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert graph.minimum_spanning_forest(e).agg(F.sum("w")).first()[0] == 6.0
    pairs = {(r.src, r.dst): r.dist for r in graph.all_pairs(e).collect()}
    assert pairs[1, 5] == 4 and pairs[2, 4] == 2 and (5, 1) not in pairs
    dom = {r.node: r.idom for r in graph.dominators(e, 1).collect()}
    assert dom == {1: None, 2: 1, 3: 1, 4: 3, 5: 1}
    post = {r.node: r.position for r in graph.postorder(e, 1).collect()}
    assert post[1] == 4 and post[5] < post[4] < post[3]
    col = {r.node: r.colour for r in graph.colour(e).collect()}
    assert all(col[a] != col[b] for a, b in ((1, 2), (2, 3), (1, 3), (3, 4), (8, 9)))
    ring = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long")
    assert {r.node: r.level for r in graph.kahn_levels(ring).collect()} == {3: 0, 1: None, 2: None}


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(C("id").alias("src"), (C("id") + 1).alias("dst"))
    assert graph.connected_components(e).where("component <> 0").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14), st.integers(1, 5)), max_size=40))
def test_forest_as_kruskal(spark, rows):
    root = list(range(15))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in rows if a != b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, float(w)))
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")
    assert sorted(tuple(r) for r in graph.minimum_spanning_forest(e).collect()) == sorted(want)


@pytest.mark.parametrize("hub", [0, 1000])
def test_components_with_hubs_salted(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB_LEAST", hub)
    e = spark.range(300).select(F.lit(7).cast("long").alias("src"), (C("id") + 1000).alias("dst")).union(spark.range(20).select((C("id") + 2000).alias("src"), (C("id") + 2001).alias("dst")))
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {7: 7, **{i + 1000: 7 for i in range(300)}, **{i + 2000: 2000 for i in range(21)}}


def test_negative_cycles_end(spark):
    e = spark.createDataFrame([(1, 2, -1.0), (2, 1, -1.0), (2, 3, 1.0)], "src long, dst long, w double")
    with pytest.raises(ValueError):
        graph.all_pairs(e)


def test_merge_takes_right_first(spark):
    a, b = (spark.createDataFrame([(1, s), (2, s)], "k int, s string") for s in "lr")
    assert vals(ordered.merge(a, b, ["k"]).select("s")) == ["r", "l", "r", "l"]


def test_colour_graph_of_all_orders(spark, data):
    from brindle.plans.queries import QUERIES

    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    got = QUERIES["colour_graph"](spark, data).collect()
    col = {r.node: r.colour for r in got}
    assert len(got) == len(col) and set(col) == {f"c{r[0]}" for r in orders} | {f"d{r[1]}" for r in orders}
    assert all(col[f"c{a}"] != col[f"d{b}"] for a, b in orders)
