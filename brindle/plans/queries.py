"""The registered queries of the core operators with their SQL. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, convert, dates, expr, hashes, jsons, maths, regexes, strings
from ..operators import aggregates, graph, joins, ordered, rows, sets, windows
from ..streaming import events as stream
from .pipeline import Query, stage
from .session import ORDER_KEYS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    """Register a function as a query of its own name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(spark: SparkSession, d: str, name: str) -> Query:
    return Query(table(spark, d, name), ORDER_KEYS[name])


LKEY = ORDER_KEYS["lineitem"]
LORD = ", ".join(LKEY)


@query("""SELECT o_custkey, sum(l_extendedprice * (1 - l_discount))::DECIMAL(18,2)::DOUBLE revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY revenue DESC, o_custkey LIMIT 10""")
def flagship(spark, d):
    """Filter, last-wins lookup, group sum, order, take."""
    made = (
        stage("where", C("l_shipdate") < F.lit("1997-01-01").cast("timestamp"))
        | stage("join", _q(spark, d, "orders"), [("l_orderkey", "o_orderkey")])
        | stage("group_by", "o_custkey", revenue=F.sum(C("l_extendedprice") * (1 - C("l_discount"))).cast("decimal(18,2)").cast("double"))
        | stage("order_by", "revenue", True)
        | stage("take", 10)
    )
    return (_q(spark, d, "lineitem") | made).df


@query("SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'")
def where_shipdate(spark, d):
    return rows.where(table(spark, d, "lineitem"), C("l_shipdate") < F.lit("1995-01-01").cast("timestamp"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice < 200000")
def where_chain(spark, d):
    return (_q(spark, d, "orders") | stage("where", C("o_orderkey") % 3 == 0) | stage("where", C("o_totalprice") < 200000)).df.select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 25")
def where_bound(spark, d):
    return rows.where_compare(table(spark, d, "part"), "p_size", ">=", 25).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE NOT (p_size < 10)")
def remove_small(spark, d):
    return rows.remove(table(spark, d, "part"), C("p_size") < 10).select("p_partkey")


@query("SELECT p_size < 10 matched, count(*) n FROM part GROUP BY 1")
def partition_size(spark, d):
    return rows.partition(table(spark, d, "part"), C("p_size") < 10).groupBy("matched").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round(p_retailprice * 1.1 + p_size, 2) scaled, (p_size << 2) | 1 bits, p_size % 7 m FROM part")
def transform_scale(spark, d):
    return rows.transform(table(spark, d, "part"), p_partkey=C("p_partkey"), scaled=F.round(C("p_retailprice") * 1.1 + C("p_size"), 2), bits=F.shiftleft("p_size", 2).bitwiseOR(F.lit(1)), m=C("p_size") % 7)


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN p_size * 2 ELSE p_size - 1 END::BIGINT v, (p_size / 3)::INT * 0 + p_size // 3 + (p_size << 1) w FROM part")
def expression_text(spark, d):
    return table(spark, d, "part").select("p_partkey", expr.evaluate("p_size > 25 && p_partkey % 2 == 0 ? p_size * 2 : p_size - 1").cast("long").alias("v"), expr.evaluate("p_size / 3 + (p_size << 1)").cast("long").alias("w"))


@query("SELECT p_partkey, round(2.0 * p_size + 3, 6)::DOUBLE slope FROM part")
def derivative_formula(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(expr.real_column(expr.derivative(expr.parse("p_size * p_size + 3 * p_size - 7"), "p_size")), 6).alias("slope"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*a?e*'")
def glob_names(spark, d):
    return table(spark, d, "part").where(strings.glob_match(C("p_name"), "*a?e*")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def skip_orders(spark, d):
    return _q(spark, d, "orders").skip(100).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def take_orders(spark, d):
    return _q(spark, d, "orders").take(25).df.select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE NOT coalesce(event_id < 40 OR value > 1e9, false)), 1e18)")
def take_while_events(spark, d):
    return ordered.take_while(table(spark, d, "events"), (C("event_id") < 40) | (C("value") > 1e9), ["event_id"]).select("event_id")


@query(f"WITH n AS (SELECT *, row_number() OVER (ORDER BY {LORD}) r FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity FROM n WHERE r >= (SELECT min(r) FROM n WHERE NOT l_quantity < 45)")
def skip_while_qty(spark, d):
    return ordered.skip_while(table(spark, d, "lineitem"), C("l_quantity") < 45, LKEY).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1")
def first_order(spark, d):
    return _q(spark, d, "orders").first().select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_order(spark, d):
    return _q(spark, d, "orders").last().select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 41")
def at_order(spark, d):
    return _q(spark, d, "orders").at(41).select("o_orderkey", "o_custkey")


@query("SELECT -1::BIGINT c_custkey, 'none' c_name")
def first_or_default(spark, d):
    none = rows.where(table(spark, d, "customer"), C("c_custkey") < 0).select("c_custkey", "c_name")
    return ordered.first_or_default(none, ["c_custkey"], c_custkey=-1, c_name="none")


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def single_region(spark, d):
    return ordered.single(rows.where(table(spark, d, "region"), C("r_name") == "ASIA"))


@query("SELECT -1 r_regionkey, 'many' r_name")
def single_or_default(spark, d):
    return ordered.single_or_default(table(spark, d, "region"), r_regionkey=-1, r_name="many")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7")
def slice_from_end(spark, d):
    return ordered.slice_rows(table(spark, d, "customer"), ["c_custkey"], -7).select("c_custkey")


@query("SELECT min(o_orderkey) o_orderkey FROM orders WHERE o_totalprice > 300000")
def find_expensive(spark, d):
    return ordered.find(table(spark, d, "orders"), C("o_totalprice") > 300000, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 ord FROM orders")
def order_by_price(spark, d):
    return ordered.with_ordinal(table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-C("o_totalprice")).alias("k")), ["k", "o_orderkey"]).drop("k")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50")
def then_by_status_price(spark, d):
    return _q(spark, d, "orders").order_by("o_orderstatus").then_by("o_totalprice", True).take(50).df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n_price(spark, d):
    return ordered.top_n(table(spark, d, "orders"), 20, C("o_totalprice").desc(), C("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders)")
def median_upper_price(spark, d):
    return ordered.upper_median(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"])


@query("""WITH n AS (SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) p, row_number() OVER (ORDER BY ts, event_id) - 1 i FROM events)
SELECT coalesce(min(CASE WHEN value < p THEN i END), count(*)) run_length, count(*) FILTER (value < p) = 0 is_sorted FROM n""")
def leading_run(spark, d):
    return ordered.leading_run(table(spark, d, "events"), "value", ["ts", "event_id"])


@query("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1 - 5 + 25) % 25 ord FROM nation")
def rotate_nations(spark, d):
    return ordered.rotate(table(spark, d, "nation"), 5, ["n_nationkey"]).select("n_nationkey", "ord")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_orders_customer(spark, d):
    return _q(spark, d, "orders").join(_q(spark, d, "customer"), [("o_custkey", "c_custkey")]).df.select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, max(o_orderkey) o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_last_wins(spark, d):
    return joins.lookup(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")], ["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_many_left(spark, d):
    return joins.join_many(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_customers(spark, d):
    return joins.semi(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_customers(spark, d):
    return joins.anti(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("""SELECT n_nationkey, c_custkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) i FROM nation)
LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) j FROM customer) ON i = j""")
def zip_tables(spark, d):
    return joins.zip_rows(table(spark, d, "nation"), table(spark, d, "customer"), ["n_nationkey"], ["c_custkey"]).select("n_nationkey", "c_custkey")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT DISTINCT user_id u, ts t FROM events WHERE event_type = 'click')
SELECT event_id, (SELECT max(t) FROM c WHERE u = user_id AND t <= ts) bound FROM p""")
def asof_events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "ts", "ts", ["user_id"]).select("event_id", "bound")


@query("""SELECT p_partkey, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey > p_size) bound FROM part""")
def upper_bound_suppliers(spark, d):
    return joins.lower_bound(table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "supplier"), "p_size", "s_suppkey", strict=True).select("p_partkey", "bound")


_SPANS = "(SELECT o_orderkey k, o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE lo, o_orderdate + INTERVAL (o_orderkey % 1440 + 10) MINUTE hi FROM orders)"
_LOADS = "(SELECT l_orderkey k, l_partkey p, l_shipdate + INTERVAL (l_partkey % 1440) MINUTE lo, l_shipdate + INTERVAL (l_partkey % 1440 + 5) MINUTE hi FROM lineitem)"


def _spans(spark, d):
    """Ten minutes of every order, and five of every line, spread over their days."""
    t, u, minute = dates.micros(C("o_orderdate")), dates.micros(C("l_shipdate")), 60_000_000
    a = table(spark, d, "orders").select(C("o_orderkey").alias("a_key"), (t + C("o_orderkey") % 1440 * minute).alias("a_lo"), (t + (C("o_orderkey") % 1440 + 10) * minute).alias("a_hi"))
    b = table(spark, d, "lineitem").select(C("l_orderkey").alias("b_key"), C("l_partkey").alias("b_part"), (u + C("l_partkey") % 1440 * minute).alias("b_lo"), (u + (C("l_partkey") % 1440 + 5) * minute).alias("b_hi"))
    return a, b, 15 * minute


@query(f"SELECT a.k a_key, b.k b_key, b.p b_part FROM {_SPANS} a JOIN {_LOADS} b ON b.hi >= a.lo AND a.hi >= b.lo")
def interval_overlap(spark, d):
    a, b, width = _spans(spark, d)
    return joins.interval_overlap(a, b, "a_lo", "a_hi", "b_lo", "b_hi", width).select("a_key", "b_key", "b_part")


@query(f"SELECT a.k a_key, b.k b_key, b.p b_part FROM {_SPANS} a JOIN {_LOADS} b ON a.lo < b.hi AND b.lo < a.hi")
def interval_strict(spark, d):
    a, b, width = _spans(spark, d)
    return joins.interval_overlap(a, b, "a_lo", "a_hi", "b_lo", "b_hi", width, strict=True).select("a_key", "b_key", "b_part")


_NEAR = """SELECT vec_id, near_id, round(dist2, 4) dist2 FROM (SELECT q.vec_id, p.vec_id near_id, list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) dist2
FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0) WHERE dist2 <= {} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist2, near_id) = 1"""


def _nearest(spark, d, most=None):
    e = table(spark, d, "embeddings")
    found = joins.nearest(e.where("vec_id % 100 = 0"), e.select(C("vec_id").alias("near_id"), "embedding"), "embedding", "vec_id", "near_id", "embedding", other=True, most=most)
    return found.select("vec_id", "near_id", F.round("dist2", 4).alias("dist2"))


@query(_NEAR.format("1e300"))
def nearest_embedding(spark, d):
    """The nearest other vector of all, for every hundredth."""
    return _nearest(spark, d)


@query(_NEAR.format("81.0"))
def nearest_within(spark, d):
    """The same within a distance of 9."""
    return _nearest(spark, d, 9.0)


@query("""SELECT a.p_partkey a, b.p_partkey b FROM part a, part b WHERE a.p_partkey < b.p_partkey AND (a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) <= 4.0""")
def points_within(spark, d):
    p = table(spark, d, "part")
    a = p.select(C("p_partkey").alias("a"), C("p_size").alias("ax"), C("p_retailprice").alias("ay"))
    b = p.select(C("p_partkey").alias("b"), C("p_size").alias("bx"), C("p_retailprice").alias("by"))
    return joins.within(a, b, [("ax", "bx"), ("ay", "by")], 2.0).where("a < b").select("a", "b")


@query("SELECT r_name name, 0 source FROM region UNION ALL SELECT n_name, 1 FROM nation")
def concat_names(spark, d):
    return sets.concat(table(spark, d, "region").select(C("r_name").alias("name")), table(spark, d, "nation").select(C("n_name").alias("name")), source="source")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) o_orderkey, arg_min(o_totalprice, o_orderkey) o_totalprice FROM orders GROUP BY 1")
def distinct_first(spark, d):
    return sets.distinct_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) p, row_number() OVER (ORDER BY ts, event_id) r FROM events) WHERE r = 1 OR event_type IS DISTINCT FROM p")
def unique_adjacent(spark, d):
    return sets.unique_adjacent(table(spark, d, "events").select("event_id", "ts", "event_type"), "event_type", ["ts", "event_id"]).select("event_id", "event_type")


_A, _B = "(SELECT DISTINCT l_partkey k FROM lineitem WHERE l_quantity > 48)", "(SELECT DISTINCT l_partkey k FROM lineitem WHERE l_discount > 0.09)"


def _sets(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_quantity > 48").select(C("l_partkey").alias("k")).distinct(), li.where("l_discount > 0.09").select(C("l_partkey").alias("k")).distinct()


@query(f"SELECT k FROM {_A} INTERSECT SELECT k FROM {_B}")
def set_intersection(spark, d):
    return sets.intersection(*_sets(spark, d))


@query(f"SELECT k FROM {_A} UNION SELECT k FROM {_B}")
def set_union(spark, d):
    return sets.union(*_sets(spark, d))


@query(f"SELECT k FROM {_A} EXCEPT SELECT k FROM {_B}")
def set_difference(spark, d):
    return sets.difference(*_sets(spark, d))


@query(f"(SELECT k FROM {_A} EXCEPT SELECT k FROM {_B}) UNION (SELECT k FROM {_B} EXCEPT SELECT k FROM {_A})")
def set_symdiff(spark, d):
    return sets.symmetric_difference(*_sets(spark, d))


@query("""WITH a AS (SELECT DISTINCT o_custkey k FROM orders), b AS (SELECT c_custkey k FROM customer), l AS (SELECT count(*) n FROM (SELECT k FROM a EXCEPT SELECT k FROM b)), r AS (SELECT count(*) n FROM (SELECT k FROM b EXCEPT SELECT k FROM a))
SELECT l.n = 0 AND r.n = 0 equal, l.n = 0 subset, l.n = 0 AND r.n > 0 proper_subset, r.n = 0 superset, r.n = 0 AND l.n > 0 proper_superset FROM l, r""")
def set_subset(spark, d):
    return sets.compare_sets(table(spark, d, "orders").select(C("o_custkey").alias("k")).distinct(), table(spark, d, "customer").select(C("c_custkey").alias("k")))


_BAGS = "WITH c AS (SELECT k, sum(a) a, sum(b) b FROM (SELECT o_custkey k, 1 a, 0 b FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 0, 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1) SELECT k, ({0})::BIGINT n FROM c WHERE {0} > 0"


def _bags(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select(C("o_custkey").alias("k")), o.where("o_orderstatus = 'F'").select(C("o_custkey").alias("k"))


@query(_BAGS.format("a + b"))
def bag_union(spark, d):
    return sets.bag_sum(*_bags(spark, d))


@query(_BAGS.format("a - b"))
def bag_difference(spark, d):
    return sets.bag_difference(*_bags(spark, d))


@query(_BAGS.format("least(a, b)"))
def bag_intersection(spark, d):
    return sets.bag_intersection(*_bags(spark, d))


@query(_BAGS.format("greatest(a, b)"))
def bag_max(spark, d):
    return sets.bag_max(*_bags(spark, d))


@query("""WITH c AS (SELECT k, sum(a) a, sum(b) b FROM (SELECT o_custkey k, 1 a, 0 b FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 0, 1 FROM orders) GROUP BY 1)
SELECT bool_and(a = b) equal, bool_and(a <= b) sub_bag, bool_and(a <= b) AND NOT bool_and(a = b) proper_sub_bag FROM c""")
def bag_compare(spark, d):
    return sets.compare_bags(_bags(spark, d)[0], table(spark, d, "orders").select(C("o_custkey").alias("k")))


@query("SELECT count(*) FILTER (l_returnflag = 'R') returned, count(*) n FROM lineitem")
def count_if_returns(spark, d):
    return aggregates.group_by(table(spark, d, "lineitem"), [], returned=aggregates.count(C("l_returnflag") == "R"), n=aggregates.count())


@query("SELECT 0::DOUBLE total, 0::BIGINT n")
def sum_empty(spark, d):
    return aggregates.group_by(table(spark, d, "orders").where("o_totalprice < 0"), [], total=aggregates.total(C("o_totalprice")).cast("double"), n=aggregates.count())


@query("SELECT round(avg(l_discount), 8) mean, (sum(l_linenumber) // count(*))::BIGINT whole FROM lineitem")
def average_discount(spark, d):
    return aggregates.group_by(table(spark, d, "lineitem"), [], mean=F.round(aggregates.average(C("l_discount")), 8), whole=aggregates.average(C("l_linenumber"), truncate=True))


@query("SELECT min(o_orderdate) lo, max(o_orderdate) hi FROM orders")
def minmax_extent(spark, d):
    return table(spark, d, "orders").agg(*aggregates.extent(C("o_orderdate")))


@query("SELECT bool_or(p_size = 50) has_50, bool_or(p_size = 5000) has_5000 FROM part")
def contains_value(spark, d):
    return aggregates.group_by(table(spark, d, "part"), [], has_50=aggregates.contains(C("p_size"), 50), has_5000=aggregates.contains(C("p_size"), 5000))


@query("SELECT l_returnflag, bool_and(l_quantity > 0) all_positive, bool_or(l_discount > 0.05) any_discount, NOT bool_or(l_tax > 1) none_taxed FROM lineitem GROUP BY 1")
def all_any_none(spark, d):
    return aggregates.group_by(table(spark, d, "lineitem"), ["l_returnflag"], all_positive=aggregates.all_of(C("l_quantity") > 0), any_discount=aggregates.any_of(C("l_discount") > 0.05), none_taxed=aggregates.none_of(C("l_tax") > 1))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def argmax_price(spark, d):
    return aggregates.argmax(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, count(l_quantity) n, round(avg(l_quantity), 6) mean, round(var_samp(l_quantity), 4) variance, round(stddev_samp(l_quantity), 6) sigma, min(l_quantity) lo, max(l_quantity) hi FROM lineitem GROUP BY 1")
def stats_by_flag(spark, d):
    s = aggregates.statistics(C("l_quantity"))
    return aggregates.group_by(table(spark, d, "lineitem"), ["l_returnflag"], n=s["n"], mean=F.round(s["mean"], 6), variance=F.round(s["variance"], 4), sigma=F.round(s["sigma"], 6), lo=s["lo"], hi=s["hi"])


@query("SELECT l_returnflag, round(sqrt(avg(l_quantity * l_quantity)), 6) rms FROM lineitem GROUP BY 1")
def rms_by_flag(spark, d):
    return aggregates.group_by(table(spark, d, "lineitem"), ["l_returnflag"], rms=F.round(aggregates.statistics(C("l_quantity"))["rms"], 6))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) mean FROM lineitem GROUP BY 1")
def weighted_discount(spark, d):
    return aggregates.group_by(table(spark, d, "lineitem"), ["l_returnflag"], mean=F.round(aggregates.weighted(C("l_discount"), C("l_quantity"))["mean"], 8))


_COV = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(covar_pop({a}, {b}), 4) + 0.0 cov FROM lineitem" for a in _COV for b in _COV))
def covariance_matrix(spark, d):
    return aggregates.covariance_matrix(table(spark, d, "lineitem"), _COV).select("a", "b", (F.round("cov", 4) + F.lit(0.0)).alias("cov"))


@query("SELECT event_type, count(*) n FROM events GROUP BY 1")
def group_count(spark, d):
    return sets.counts(table(spark, d, "events").select("event_type"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) orders FROM orders GROUP BY 1")
def group_collect(spark, d):
    got = aggregates.group_collect(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey"])
    return got.select("o_custkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) last FROM events GROUP BY 1")
def group_last(spark, d):
    return aggregates.group_last(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT o_custkey, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE result FROM orders GROUP BY 1")
def fold_sum(spark, d):
    got = aggregates.fold(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"], F.lit(0.0), lambda a, x: a + x)
    return got.select("o_custkey", C("result").cast("decimal(18,2)").cast("double").alias("result"))


@query("SELECT event_type, row_number() OVER (ORDER BY min(ts), min(event_id)) - 1 id FROM (SELECT event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1) GROUP BY 1")
def dictionary_encode(spark, d):
    return aggregates.dictionary(table(spark, d, "events"), "event_type", ["ts", "event_id"])


@query("""WITH b AS (SELECT event_type, count(*) n, sum(value) v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type, count(*) n, sum(value) v FROM events GROUP BY 1)
SELECT a.event_type, a.n - coalesce(b.n, 0) n, round(a.v - coalesce(b.v, 0), 3) v FROM a LEFT JOIN b USING (event_type)""")
def snapshot_delta(spark, d):
    e = table(spark, d, "events")
    totals = lambda x: aggregates.group_by(x, ["event_type"], n=F.count("*"), v=F.sum("value"))
    return aggregates.snapshot_delta(totals(e.where("event_id % 2 = 0")), totals(e), ["event_type"], ["n", "v"]).select("event_type", "n", F.round("v", 3).alias("v"))


@query("SELECT chunk, count(*) n, min(o_orderkey) lo FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 chunk FROM orders) GROUP BY 1")
def chunk_n(spark, d):
    return windows.chunks(table(spark, d, "orders").select("o_orderkey"), 64, ["o_orderkey"]).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) mean FROM events")
def moving_avg(spark, d):
    return windows.moving_average(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 5).select("event_id", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, round(3.0 / nullif((epoch_us(ts) - epoch_us(lag(ts, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 0), 9) rate FROM events")
def frame_rate(spark, d):
    return windows.frame_rate(table(spark, d, "events"), "ts", ["user_id"], ["ts", "event_id"], 3).select("event_id", F.round("rate", 9).alias("rate"))


@query("""SELECT event_id, round(0.25 * coalesce(lag(value) OVER w, value) + 0.5 * value + 0.25 * coalesce(lead(value) OVER w, value), 6) filtered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def fir_filter(spark, d):
    return windows.fir(table(spark, d, "events"), "value", [0.25, 0.5, 0.25], ["user_id"], ["ts", "event_id"]).select("event_id", F.round("filtered", 6).alias("filtered"))


@query("""WITH g AS (SELECT p_size i, (p_partkey % 20)::INT j, sum(p_retailprice) v FROM part GROUP BY 1, 2)
SELECT a.i, a.j, round(sum(b.v * CASE WHEN a.i = b.i AND a.j = b.j THEN 0.5 ELSE 0.0625 END), 6) v FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2""")
def convolution(spark, d):
    g = table(spark, d, "part").groupBy(C("p_size").alias("i"), (C("p_partkey") % 20).cast("int").alias("j")).agg(F.sum("p_retailprice").alias("v"))
    k = [[0.0625, 0.0625, 0.0625], [0.0625, 0.5, 0.0625], [0.0625, 0.0625, 0.0625]]
    return windows.convolve2d(g, k).select("i", "j", F.round("v", 6).alias("v"))


@query("SELECT event_type, (event_id // 50)::BIGINT bin, round(avg(value), 6) \"value\" FROM events GROUP BY 1, 2")
def resample_events(spark, d):
    return windows.resample(table(spark, d, "events"), "event_id", "value", 1 / 50, ["event_type"]).select("event_type", "bin", F.round("value", 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w, 6) + 0.0 z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def zscore(spark, d):
    return windows.zscore(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER w) / CASE WHEN max(p_retailprice) OVER w = min(p_retailprice) OVER w THEN 1 ELSE max(p_retailprice) OVER w - min(p_retailprice) OVER w END, 8) scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def minmax_scale(spark, d):
    return windows.minmax_scale(table(spark, d, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", F.round("scaled", 8).alias("scaled"))


@query("WITH m AS (SELECT p_partkey, p_brand, exp(0.1 * p_size - max(0.1 * p_size) OVER (PARTITION BY p_brand)) e FROM part) SELECT p_partkey, round(e / sum(e) OVER (PARTITION BY p_brand), 8) p FROM m")
def softmax(spark, d):
    return windows.softmax(table(spark, d, "part"), "p_size", ["p_brand"], beta=0.1).select("p_partkey", F.round("p", 8).alias("p"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::INT lev FROM part")
def levenshtein_names(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.edit_distance(C("p_name"), C("p_type")).alias("lev"))


@query("SELECT p_partkey, damerau_levenshtein(p_brand, 'Brand#21')::INT d FROM part")
def edit_swaps(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.edit_distance_swaps(C("p_brand"), F.lit("Brand#21")).alias("d"))


@query("""SELECT p_partkey, lower(p_name) low, upper(p_name) up, instr(p_name, 'a') - 1 at_a, length(p_name) - length(replace(p_name, 'e', '')) n_e, p_name[2:5] mid, right(p_name, 3) tail, replace(p_name, 'a', 'AA') rep, lpad(p_partkey::VARCHAR, 8, '0') pad, reverse(p_name) rev FROM part""")
def string_functions(spark, d):
    n = C("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.lower(n).alias("low"), F.upper(n).alias("up"), strings.find(n, "a").alias("at_a"), strings.count_of(n, "e").alias("n_e"), strings.slice_text(n, 1, 5).alias("mid"), strings.slice_text(n, -3).alias("tail"),
        strings.replace_all(n, "a", "AA").alias("rep"), strings.format_int(C("p_partkey"), 8, True).alias("pad"), F.reverse(n).alias("rev"),
    )


@query("SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) num, regexp_matches(p_name, '^[a-z ]+$') lower_only FROM part")
def regex_extract(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"([0-9]+)", 1).alias("num"), regexes.match(C("p_name"), "[a-z ]+").alias("lower_only"))


@query("SELECT p_partkey, CASE WHEN least(coalesce(nullif(instr(p_type, 'STEEL'), 0), 999), coalesce(nullif(instr(p_type, 'BRASS'), 0), 999), coalesce(nullif(instr(p_type, 'E'), 0), 999)) = 999 THEN -1 WHEN coalesce(nullif(instr(p_type, 'STEEL'), 0), 999) <= least(coalesce(nullif(instr(p_type, 'BRASS'), 0), 999), coalesce(nullif(instr(p_type, 'E'), 0), 999)) THEN 0 WHEN coalesce(nullif(instr(p_type, 'BRASS'), 0), 999) <= coalesce(nullif(instr(p_type, 'E'), 0), 999) THEN 1 ELSE 2 END id FROM part")
def regex_set(spark, d):
    return table(spark, d, "part").select("p_partkey", regexes.first_of(C("p_type"), ["STEEL", "BRASS", "E"]).alias("id"))


@query(r"SELECT p_partkey, p_name trimmed, length(p_name) n FROM part")
def trim_ctrl(spark, d):
    padded = F.concat(F.lit(" \t\n\x01"), C("p_name"), F.lit("\r\n \x02"))
    return table(spark, d, "part").select("p_partkey", strings.trim(padded).alias("trimmed"), F.length(strings.trim(padded)).alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP a, date_trunc('year', o_orderdate)::TIMESTAMP b, o_orderdate::DATE::TIMESTAMP c, date_trunc('second', o_orderdate)::TIMESTAMP e FROM orders")
def date_iso_parse(spark, d):
    t = C("o_orderdate")
    iso = lambda p: dates.parse_iso(p)[0]
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"), F.lit("-"), (F.weekday(t) + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", iso(F.date_format(t, "yyyy-DDD")).cast("timestamp").alias("a"), iso(F.date_format(t, "yyyy")).alias("b"), iso(week).alias("c"), iso(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("e"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) AS n_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diff_days(spark, d):
    j = joins.lookup(table(spark, d, "lineitem"), table(spark, d, "orders"), [("l_orderkey", "o_orderkey")], ["o_orderkey"])
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (dates.day_number(C("l_shipdate").cast("date")) - dates.day_number(C("o_orderdate").cast("date"))).cast("long").alias("n_days"))


@query("""SELECT o_orderkey, dayofweek(o_orderdate)::INT dow, day(last_day(o_orderdate))::INT month_days, year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) leap,
(epoch_us(o_orderdate) + 11644473600000000) * 10 filetime, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') iso FROM orders""")
def date_functions(spark, d):
    t = C("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.day_of_week(t).alias("dow"), dates.days_in_month(F.year(t), F.month(t)).alias("month_days"), dates.is_leap(F.year(t)).alias("leap"), dates.to_filetime(t).alias("filetime"), dates.format_iso(t).alias("iso"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", jsons.get(C("props"), "k", "long").alias("k"))


_EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90}}, "maxProperties": 1}


@query("SELECT event_id, coalesce((props::JSON->>'k')::BIGINT >= 10 AND (props::JSON->>'k')::BIGINT < 90, false) ok FROM events")
def json_schema_subset(spark, d):
    return table(spark, d, "events").select("event_id", jsons.valid(C("props"), _EVENT_SCHEMA).alias("ok"))


@query("SELECT event_id, '$[''k'']' path, props::JSON->>'k' \"value\" FROM events WHERE (props::JSON->>'k') IS NOT NULL")
def find_by_name(spark, d):
    return jsons.find_by_name(table(spark, d, "events").select("event_id", "props"), "props", "k*").select("event_id", "path", "value")


@query("SELECT event_id, props::JSON->>'k' \"value\" FROM events WHERE (props::JSON->>'k') LIKE '6_'")
def find_by_value(spark, d):
    return jsons.find_by_value(table(spark, d, "events").select("event_id", "props"), "props", "6?").select("event_id", "value")


@query("""SELECT p_partkey, bit_count(p_size)::INT bits, xor(p_size, 5)::BIGINT flipped, gcd(p_size, 36)::BIGINT g, least(greatest(p_size, 10), 20) c, round(1 / (1 + exp(-p_size / 10.0)), 8) s, round(p_size * 0.25 + 3 * 0.75, 6)::DOUBLE l FROM part""")
def math_functions(spark, d):
    s = C("p_size")
    return table(spark, d, "part").select("p_partkey", F.bit_count(s).alias("bits"), maths.bit_flip(maths.bit_flip(s, 0), 2).alias("flipped"), maths.gcd(s, F.lit(36)).alias("g"), maths.clamp(s, 10, 20).alias("c"), F.round(maths.sigmoid(s / 10.0), 8).alias("s"), F.round(maths.lerp(F.lit(3.0), s, F.lit(0.25)), 6).alias("l"))


@query("SELECT p_partkey, md5(p_name) m, sha256(p_name) s, hex(p_brand) h, base64(encode(p_name)) b FROM part")
def hash_functions(spark, d):
    n = C("p_name")
    return table(spark, d, "part").select("p_partkey", hashes.md5(n).alias("m"), hashes.sha2(n).alias("s"), F.upper(hashes.to_hex(C("p_brand"))).alias("h"), hashes.to_base64(n).alias("b"))


@query("SELECT vec_id, list_sum(list_transform(embedding[2:4], lambda x: x::DOUBLE))::DECIMAL(18,4)::DOUBLE part_sum, len(embedding[-2:])::INT n FROM embeddings")
def array_functions(spark, d):
    e = C("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(arrays.sub_array(e, 1, 3), F.lit(0.0), lambda a, x: a + x.cast("double")).cast("decimal(18,4)").cast("double").alias("part_sum"), F.size(arrays.slice_array(e, -2)).alias("n"))


@query("SELECT p_partkey, p_size::BIGINT size_number, p_size::DOUBLE size_real FROM part")
def conversion_chain(spark, d):
    r = convert.default_registry()
    text = F.concat(C("p_size").cast("string"), F.lit(" units"))
    return table(spark, d, "part").select("p_partkey", r.convert(text, "string", "long").alias("size_number"), r.convert(r.convert(text, "string", "long"), "long", "double").alias("size_real"))


_EDGES = "(SELECT DISTINCT 'c' || o_custkey src, 'd' || o_orderkey dst FROM orders)"


def _edges(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("d"), "o_orderkey").alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}), r AS (SELECT src node, src root FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node)
SELECT node, min(root) component FROM r GROUP BY 1""")
def connected_components(spark, d):
    return graph.connected_components(_edges(spark, d))


_TREE = "(SELECT DISTINCT o_orderkey src, o_orderkey * 2 + o_custkey % 2 dst FROM orders)"


def _tree(spark, d):
    return table(spark, d, "orders").select(C("o_orderkey").alias("src"), (C("o_orderkey") * 2 + C("o_custkey") % 2).alias("dst")).distinct()


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_TREE}), r AS (SELECT 1::BIGINT node, 0 hops UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE hops < 60) SELECT node, min(hops) hops FROM r GROUP BY 1")
def reachability(spark, d):
    return graph.reachable(_tree(spark, d), spark.range(1, 2).select(C("id").alias("node")))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_TREE}), l AS (SELECT dst node, 0 level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.node)
SELECT node, max(level) level FROM (SELECT src node FROM e UNION SELECT dst FROM e) LEFT JOIN l USING (node) GROUP BY 1""")
def kahn_levels(spark, d):
    return graph.kahn_levels(_tree(spark, d))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, (dst % 7 + 1)::DOUBLE w FROM {_TREE}), r AS (SELECT 1::BIGINT node, 0::DOUBLE dist UNION SELECT e.dst, r.dist + e.w FROM r JOIN e ON e.src = r.node)
SELECT node, min(dist) dist FROM r GROUP BY 1""")
def shortest_paths(spark, d):
    e = _tree(spark, d).withColumn("w", (C("dst") % 7 + 1).cast("double"))
    return graph.shortest_paths(e, 1).select("node", "dist")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END s, event_id FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM g) SELECT user_id, min(ts) "start", max(ts) + INTERVAL 1 HOUR "end", count(*) n FROM n GROUP BY user_id, k""")
def session_events(spark, d):
    return stream.sessions(table(spark, d, "events"), "ts", "1 hour", ["user_id"], n=F.count("*"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) \"start\", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR \"end\", event_type, count(*) n, round(sum(value), 3) total FROM events GROUP BY 1, 2, 3")
def tumbling_events(spark, d):
    return stream.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 3))


@query("SELECT user_id, arg_max(props, (ts, event_id)) props FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def latest_state(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(C("event_type") == "error", "delete").otherwise("put").alias("op"), "props", F.struct("ts", "event_id").alias("o"))
    return stream.latest(e, "user_id", "op", "props", "o")


@query("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 j, count(*) OVER (PARTITION BY user_id) n FROM events)
SELECT a.user_id, a.j k, round(sum(b.value * cos(-2 * pi() * ((a.j * b.j) % a.n) / a.n)), 4) + 0 re, round(sum(b.value * sin(-2 * pi() * ((a.j * b.j) % a.n) / a.n)), 4) + 0 im FROM n a JOIN n b USING (user_id) GROUP BY ALL""")
def fft_values(spark, d):
    return windows.fft(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("user_id", "k", (F.round("re", 4) + 0).alias("re"), (F.round("im", 4) + 0).alias("im"))


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
k AS (SELECT event_id, user_id, i, value x, 25.0::DOUBLE p FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.user_id, n.i, k.x + (k.p + 1) / (k.p + 26) * (n.value - k.x), (1 - (k.p + 1) / (k.p + 26)) * (k.p + 1) FROM k JOIN n ON n.user_id = k.user_id AND n.i = k.i + 1)
SELECT event_id, round(x, 4) estimate FROM k""")
def ekf_values(spark, d):
    return windows.kalman(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 1.0, 25.0).select("event_id", F.round("estimate", 4).alias("estimate"))


def _blocks(spark, d):
    """Each order with the next three of its block of eight; the weights are the sums of their prices."""
    o = table(spark, d, "orders").select(C("o_orderkey").alias("k"), C("o_totalprice").alias("p"))
    b = o.toDF("k2", "p2")
    near = o.select("k", "p", F.explode(F.array(*[C("k") + i for i in (1, 2, 3)])).alias("to")).join(b, (C("to") == C("k2")) & (F.floor(C("k") / 8) == F.floor(C("k2") / 8)))
    return near.select(C("k").alias("src"), C("k2").alias("dst"), F.round(C("p") + C("p2"), 2).alias("w"))


@query("""WITH RECURSIVE e AS (SELECT a.o_orderkey src, b.o_orderkey dst, round(a.o_totalprice + b.o_totalprice, 2) w FROM orders a JOIN orders b ON b.o_orderkey - a.o_orderkey BETWEEN 1 AND 3 AND a.o_orderkey // 8 = b.o_orderkey // 8),
s AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e),
r AS (SELECT src, dst, w, src node FROM e UNION SELECT r.src, r.dst, r.w, s.dst FROM r JOIN s ON s.src = r.node AND (s.w, least(s.src, s.dst), greatest(s.src, s.dst)) < (r.w, r.src, r.dst))
SELECT src, dst, w FROM r GROUP BY ALL HAVING NOT bool_or(node = dst)""")
def spanning_forest(spark, d):
    """An edge is in the forest unless lighter ones connect its ends."""
    return graph.minimum_spanning_forest(_blocks(spark, d))


@query("SELECT 'c' || o_custkey node, 0 colour FROM orders UNION SELECT 'd' || o_orderkey, 1 FROM orders")
def colour_graph(spark, d):
    """Breadth first from the smallest node, the customer, so that orders have the second colour."""
    return graph.colour(_edges(spark, d))


_NATIONS = "(SELECT DISTINCT n_nationkey::BIGINT src, unnest([(n_nationkey * 2 + 1) % 25, (n_nationkey + n_regionkey + 1) % 25])::BIGINT dst FROM nation)"


def _nations(spark, d):
    n, r = C("n_nationkey"), C("n_regionkey")
    return table(spark, d, "nation").select(n.cast("long").alias("src"), F.explode(F.array(*[x.cast("long") for x in ((n * 2 + 1) % 25, (n + r + 1) % 25)])).alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_NATIONS}), x AS (SELECT -1::BIGINT cut UNION SELECT src FROM e UNION SELECT dst FROM e),
r AS (SELECT cut, 0::BIGINT node FROM x WHERE cut <> 0 UNION SELECT r.cut, e.dst FROM r JOIN e ON e.src = r.node AND e.dst <> r.cut),
f AS (SELECT node FROM r WHERE cut = -1), s AS (SELECT f.node, d.node dom FROM f JOIN f d ON d.node <> f.node WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cut = d.node AND r.node = f.node)),
n AS (SELECT node, count(*) c FROM s GROUP BY 1)
SELECT f.node, arg_max(s.dom, coalesce(n.c, 0)) idom FROM f LEFT JOIN s ON s.node = f.node LEFT JOIN n ON n.node = s.dom GROUP BY 1""")
def dominator_tree(spark, d):
    """A node's dominators are those without which it is not reached; the immediate one has the most dominators itself."""
    return graph.dominators(_nations(spark, d), 0)


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, (dst % 7 + 1)::DOUBLE w FROM {_NATIONS} WHERE src <> dst), r AS (SELECT src, dst, w FROM e UNION SELECT r.src, e.dst, r.w + e.w FROM r JOIN e ON e.src = r.dst WHERE r.w + e.w <= 100 AND e.dst <> r.src)
SELECT src, dst, min(w) dist FROM r GROUP BY 1, 2""")
def all_pair_distances(spark, d):
    return graph.all_pairs(_nations(spark, d).withColumn("w", (C("dst") % 7 + 1).cast("double"))).select("src", "dst", "dist")


@query("""WITH t AS (SELECT 0::BIGINT node, [1000000::BIGINT, 1000000, 1000000] p UNION ALL SELECT r_regionkey + 1, [r_regionkey + 1, 1000000, 1000000] FROM region
UNION ALL SELECT n_nationkey + 100, [n_regionkey + 1, n_nationkey + 100, 1000000] FROM nation UNION ALL SELECT s_suppkey + 1000, [n_regionkey + 1, n_nationkey + 100, s_suppkey + 1000] FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT node, row_number() OVER (ORDER BY p) - 1 position FROM t""")
def postorder_positions(spark, d):
    """Regions, nations and suppliers as a tree."""
    r = table(spark, d, "region").select(F.lit(0).cast("long").alias("src"), (C("r_regionkey") + 1).cast("long").alias("dst"))
    n = table(spark, d, "nation").select((C("n_regionkey") + 1).cast("long"), (C("n_nationkey") + 100).cast("long"))
    s = table(spark, d, "supplier").select((C("s_nationkey") + 100).cast("long"), (C("s_suppkey") + 1000).cast("long"))
    return graph.postorder(r.union(n).union(s), 0)


from . import queries_scalar, queries_sources  # noqa: E402, F401  (they register their queries here)
