"""Registered queries of sources, scalar functions and small operators with their SQL. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, convert, dates, expr, hashes, jsons, maths, regexes, strings
from ..operators import aggregates, joins, ordered, rows, sets, windows
from ..streaming import events as stream
from .queries import query
from .session import ORDER_KEYS, table

C = F.col


@query("SELECT range x, 7 v FROM range(5, 1001)")
def int_range_rows(spark, d):
    a = rows.int_range(spark, 5, 1000, inclusive=True)
    return a.join(rows.repeat(spark, 7, 1, "v"), F.lit(True))


@query("SELECT count(*) n, min(v) lo, max(v) hi FROM (SELECT 'x' v FROM range(500))")
def repeat_rows(spark, d):
    return rows.repeat(spark, "x", 500, "v").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("SELECT n_nationkey, n_name FROM nation")
def iterate_nations(spark, d):
    """Rows through the driver's iterator and back."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame(list(rows.iterate(n)), n.schema)


@query("SELECT r_regionkey, r_name FROM region")
def array_of_regions(spark, d):
    """A small result as an Arrow table and back."""
    return spark.createDataFrame(rows.to_array(table(spark, d, "region").select("r_regionkey", "r_name")))


@query("SELECT count(*) visited FROM orders")
def for_each_order(spark, d):
    """Every row visited on the executors, counted by an accumulator."""
    seen = spark.sparkContext.accumulator(0)

    def visit(part):
        for _ in part:
            seen.add(1)

    rows.for_each(table(spark, d, "orders").select("o_orderkey"), visit)
    return spark.createDataFrame([(seen.value,)], "visited long")


@query("SELECT p_partkey, abs(p_size - 25)::INT a, greatest(p_size, 10) hi, least(p_size, 40) lo, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END s FROM part")
def deferred_select(spark, d):
    return table(spark, d, "part").select("p_partkey", F.abs(C("p_size") - 25).alias("a"), F.greatest("p_size", F.lit(10)).alias("hi"), F.least("p_size", F.lit(40)).alias("lo"), F.when(C("p_size") > 20, "big").otherwise("small").alias("s"))


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END::BIGINT c, (greatest(p_size, 10) + abs(p_size - 30))::BIGINT f FROM part")
def expression_calls(spark, d):
    return table(spark, d, "part").select("p_partkey", expr.evaluate("p_size <=> 25").alias("c"), expr.evaluate("max(p_size, 10) + abs(p_size - 30)").cast("long").alias("f"))


@query("SELECT vec_id, embedding[3]::DOUBLE a, embedding[1]::DOUBLE b FROM embeddings")
def expression_fields(spark, d):
    """Fields and indexes of a nested column in a text expression."""
    e = table(spark, d, "embeddings").select("vec_id", F.struct(C("embedding").alias("values")).alias("r"))
    return e.select("vec_id", expr.evaluate("r.values[2]").cast("double").alias("a"), expr.evaluate("r.values[1 - 1]").cast("double").alias("b"))


@query("SELECT n_nationkey, n_name FROM nation")
def names_by_hash(spark, d):
    """Ids that are CRC-32 values, resolved to their names."""
    n = table(spark, d, "nation")
    ids = n.select("n_nationkey", F.crc32(C("n_name").cast("binary")).alias("id"))
    return joins.by_name_hash(ids, n.select("n_name"), "id", "n_name").select("n_nationkey", "n_name")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) - 1 i FROM part")
def reversed_parts(spark, d):
    n = table(spark, d, "part").count()
    return ordered.with_ordinal(ordered.reverse(table(spark, d, "part").select("p_partkey"), ["p_partkey"]), ["p_partkey"], "o").select("p_partkey", (F.lit(n - 1) - C("o")).alias("i"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def reverse_sorted(spark, d):
    c = table(spark, d, "customer")
    return ordered.top_n(c, 30, C("c_acctbal").desc(), C("c_custkey")).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 nth FROM customer QUALIFY nth < 50")
def priority_order(spark, d):
    """What a queue with the greatest balance first hands out."""
    first = ordered.top_n(table(spark, d, "customer"), 50, C("c_acctbal").desc(), C("c_custkey")).withColumn("lower", -C("c_acctbal"))
    return ordered.with_ordinal(first, ["lower", "c_custkey"], "nth").select("c_custkey", "nth")


@query("""SELECT k, side, row_number() OVER (ORDER BY k, side DESC) - 1 i FROM (SELECT c_nationkey::BIGINT k, 'left' side FROM customer WHERE c_custkey <= 100 UNION ALL SELECT s_nationkey::BIGINT, 'right' FROM supplier)""")
def merged_keys(spark, d):
    """Two ordered inputs merged; on ties the right one comes first."""
    a = table(spark, d, "customer").where("c_custkey <= 100").select(C("c_nationkey").cast("long").alias("k"), F.lit("left").alias("side"))
    b = table(spark, d, "supplier").select(C("s_nationkey").cast("long").alias("k"), F.lit("right").alias("side"))
    both = ordered.merge(a, b, ["k"]).withColumn("o", F.when(C("side") == "right", 0).otherwise(1))
    return ordered.with_ordinal(both, ["k", "o"], "i").select("k", "side", "i")


@query("SELECT count(*) n, sum(p_partkey)::BIGINT s, true moved FROM part")
def shuffled_parts(spark, d):
    """A fixed random order keeps every row and is not the sorted one."""
    p = table(spark, d, "part").select("p_partkey")
    order = p.select("p_partkey", F.xxhash64(F.lit(3), C("p_partkey")).alias("h"))
    run = ordered.leading_run(order, "p_partkey", ["h", "p_partkey"]).select((~C("is_sorted")).alias("moved"))
    return ordered.shuffle(p, 3, ["p_partkey"]).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("s")).join(F.broadcast(run), F.lit(True))


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
def complement_sizes(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    sizes = sets.complement(p.select("p_size"), table(spark, d, "nation").select(C("n_nationkey").alias("p_size")))
    return p.join(sizes.distinct(), "p_size").select("p_partkey")


@query("SELECT s_nationkey i, s_suppkey % 7 j, round(avg(s_acctbal), 4) v FROM supplier GROUP BY 1, 2")
def supplier_grid(spark, d):
    return _grid(spark, d).select("i", "j", F.round("v", 4).alias("v"))


def _grid(spark, d):
    return table(spark, d, "supplier").groupBy(C("s_nationkey").alias("i"), (C("s_suppkey") % 7).alias("j")).agg(F.avg("s_acctbal").alias("v"))


_GRID = "(SELECT s_nationkey i, s_suppkey % 7 j, avg(s_acctbal) v FROM supplier GROUP BY 1, 2)"


@query(f"""WITH g AS (SELECT * FROM {_GRID}) SELECT a.i, a.j, round(sum(b.v) / count(b.v), 7) mean FROM g a JOIN g b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1
WHERE a.j IN (SELECT j FROM g x WHERE x.i = b.i) GROUP BY 1, 2""")
def box_mean(spark, d):
    return windows.box_average(_grid(spark, d), 3, 3).select("i", "j", F.round("mean", 7).alias("mean"))


@query(f"SELECT (i // 2)::BIGINT i, (j // 2)::BIGINT j, round(avg(v), 7) v FROM {_GRID} GROUP BY 1, 2")
def halved_grid(spark, d):
    return windows.halve(_grid(spark, d)).select("i", "j", F.round("v", 7).alias("v"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 60e6 t, value v FROM events), k AS (SELECT user_id, unnest(range(floor(t / 60)::BIGINT - 1, floor(t / 60)::BIGINT + 3)) bin, t, v FROM e),
w AS (SELECT user_id, bin, v, greatest(0, 1 - abs(t / 60 - bin - 0.5)) w FROM k) SELECT user_id, bin, round(sum(w * v) / sum(w), 4) "value" FROM w WHERE w > 0 GROUP BY 1, 2""")
def kernel_resample(spark, d):
    """Hourly values by a tent of one hour to either side."""
    e = table(spark, d, "events").withColumn("t", dates.micros(C("ts")) / 60e6)
    return windows.resample_kernel(e, "t", "value", 1 / 60, 1.0, ["user_id"]).select("user_id", "bin", F.round("value", 4).alias("value"))


@query(f"""WITH g AS (SELECT i, j, 1 k, v FROM {_GRID} UNION ALL SELECT i, j, 2, v / 2 FROM {_GRID}) SELECT a.i, a.j, a.k, round(sum(b.v * (4 - abs(a.i - b.i) - abs(a.j - b.j) - abs(a.k - b.k))), 6) v
FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY 1, 2, 3""")
def convolution_3d(spark, d):
    g = _grid(spark, d).withColumn("k", F.lit(1))
    cells = g.unionByName(g.withColumn("k", F.lit(2)).withColumn("v", C("v") / 2))
    kernel = [[[4 - abs(a) - abs(b) - abs(c) for c in (-1, 0, 1)] for b in (-1, 0, 1)] for a in (-1, 0, 1)]
    return windows.convolve(cells, kernel, ["i", "j", "k"]).select("i", "j", "k", F.round("v", 6).alias("v"))


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, value z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
s AS (SELECT NULL::BIGINT event_id, user_id, 0::BIGINT i, 1.0::DOUBLE x, 10.0::DOUBLE p FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT event_id, user_id, i, m + g * (z - sqrt(m * m + 1)), (1 - g * h) * q FROM (SELECT *, q * h / (h * q * h + 4) g FROM (SELECT *, m / sqrt(m * m + 1) h FROM (SELECT n.event_id, n.user_id, n.i, n.z, 0.9 * s.x + 1 m, 0.9 * s.p * 0.9 + 0.5 q FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1))))
SELECT event_id, round(x, 5) x, round(p, 5) p FROM s WHERE i > 0""")
def extended_filter(spark, d):
    """A level that decays and is seen through a curve."""
    import numpy as np

    got = windows.extended_kalman(
        table(spark, d, "events"), ["value"], ["user_id"], ["ts", "event_id"], lambda x: 0.9 * x + 1, lambda x: [[0.9]], lambda x: np.sqrt(x * x + 1), lambda x: x / np.sqrt(x * x + 1), [[0.5]], [[4.0]], [1.0], [[10.0]]
    )
    return got.select("event_id", F.round(C("state")[0], 5).alias("x"), F.round(C("variance")[0], 5).alias("p"))


@query("SELECT c_custkey, round((1 + 2e-6) * (x - 1e-5 * y) + 100, 3) x, round((1 + 2e-6) * (1e-5 * x + y) - 50, 3) y, round((1 + 2e-6) * z + 20, 3) z FROM (SELECT c_custkey, 6378137.0 + c_acctbal x, c_acctbal * 2 y, c_custkey * 1.0 z FROM customer)")
def datum_shifted(spark, d):
    import math

    x, y, z = maths.datum_shift(F.lit(6378137.0) + C("c_acctbal"), C("c_acctbal") * 2, C("c_custkey").cast("double"), (100.0, -50.0, 20.0), (0.0, 0.0, math.degrees(1e-5) * 3600), 2.0)
    return table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / sqrt(avg(l_quantity * l_quantity) OVER (PARTITION BY l_returnflag)), 6) scaled FROM lineitem")
def rms_scaled(spark, d):
    return windows.rms_scale(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT count(*) n, true close, true exact FROM events")
def approximate_counts(spark, d):
    """Approximate distinct count and quantiles lie within their errors of the exact ones."""
    e = table(spark, d, "events")
    a = e.agg(F.count("*").alias("n"), aggregates.approx_distinct(C("user_id"), 0.02).alias("u"), F.count_distinct("user_id").alias("x"), aggregates.approx_quantiles(C("value"), [0.25, 0.5, 0.75], 10_000).alias("q"), F.percentile("value", F.array(*map(F.lit, (0.24, 0.49, 0.74, 0.26, 0.51, 0.76)))).alias("p"))
    inside = F.lit(True)
    for i in range(3):
        inside = inside & (C("q")[i] >= C("p")[i]) & (C("q")[i] <= C("p")[i + 3])
    return a.select("n", (F.abs(C("u") - C("x")) <= 0.08 * C("x")).alias("close"), inside.alias("exact"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return aggregates.cube(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=F.count("*"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d):
    return aggregates.rollup(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=F.count("*"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') urgent, count(*) FILTER (o_orderpriority = '5-LOW') low FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    p = aggregates.pivot(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "5-LOW"], F.count(F.lit(1)))
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


_PAIRS = "(SELECT row_number() OVER (ORDER BY n_nationkey) i, n_name a FROM nation) JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) i, s_name b FROM supplier) USING (i)"


@query(f"SELECT bool_and(a < b) \"all\", bool_or(a < b) \"any\", NOT bool_or(a < b) \"none\", min(i) FILTER (a < b) - 1 \"first\" FROM {_PAIRS}")
def pairwise_predicates(spark, d):
    """Predicates over the i-th rows of two sequences."""
    a, b = table(spark, d, "nation").select("n_nationkey", C("n_name").alias("a")), table(spark, d, "supplier").select("s_suppkey", C("s_name").alias("b"))
    p, keys = C("a") < C("b"), (["n_nationkey"], ["s_suppkey"])
    one = joins.all_of2(a, b, *keys, p).join(joins.any_of2(a, b, *keys, p), F.lit(True)).join(joins.none_of2(a, b, *keys, p), F.lit(True))
    return one.join(joins.find_if2(a, b, *keys, p).select(C("ord").alias("first")), F.lit(True), "left")


# ------------------------------------------------------------------ texts


@query("SELECT doc_id, length(text)::INT n, octet_length(encode(text))::INT b, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' blank FROM documents")
def text_lengths(spark, d):
    t = C("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), strings.byte_length(t).alias("b"), strings.is_blank(t).alias("blank"))


@query("""SELECT p_partkey, starts_with(p_name, 's') b, ends_with(p_name, 'n') e, CASE WHEN contains(p_name, 'a') THEN length(p_name) - strpos(reverse(p_name), 'a') ELSE -1 END::INT r,
CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END c, lower(p_name) = lower(p_brand) i FROM part""")
def text_comparison(spark, d):
    n = C("p_name")
    return table(spark, d, "part").select("p_partkey", strings.begins(n, "s").alias("b"), strings.ends(n, "n").alias("e"), strings.rfind(n, "a").alias("r"), strings.compare(n, C("p_type")).alias("c"), strings.equal_ignoring_case(n, C("p_brand")).alias("i"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z]+') low, regexp_full_match(p_brand, '[A-Za-z0-9]+') alnum, regexp_full_match(p_size::VARCHAR, '[0-9]+') digit, regexp_full_match(p_type, '[A-Z]+') up FROM part")
def character_classes(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.has_class(C("p_name"), "lower").alias("low"), strings.has_class(C("p_brand"), "alnum").alias("alnum"), strings.has_class(C("p_size").cast("string"), "digit").alias("digit"), strings.has_class(C("p_type"), "upper").alias("up"))


@query("SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: x <> ''))::INT n, list_filter(string_split(p_type, ' '), lambda x: x <> '')[1] \"first\", len(string_split(p_name, 'a'))::INT k FROM part")
def split_types(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(strings.parts(C("p_type"), " ")).alias("n"), F.get(strings.parts(C("p_type"), " "), 0).alias("first"), F.size(strings.parts(C("p_name"), "a", keep_empty=True)).alias("k"))


@query("""SELECT p_partkey, p_size::BIGINT a, p_size::BIGINT b, (p_size * -1.5)::DOUBLE f, p_size % 2 = 1 t, '00000000-0000-0000-0000-' || lpad(p_partkey::VARCHAR, 12, '0') g, -1 * p_size::BIGINT h FROM part""")
def parsed_values(spark, d):
    s, k = C("p_size").cast("string"), C("p_partkey").cast("string")
    flag = F.when(C("p_size") % 2 == 1, " Yes").otherwise("off ")
    guid = F.concat(F.lit("{00000000-0000-0000-0000-"), F.lpad(k, 12, "0"), F.lit("}"))
    return table(spark, d, "part").select(
        "p_partkey", strings.parse_int(F.concat(F.lit(" "), s, F.lit("px"))).alias("a"), strings.parse_prefixed(F.concat(F.lit("0x"), F.lower(F.hex("p_size")))).alias("b"),
        strings.parse_float(F.concat((C("p_size") * -1.5).cast("string"), F.lit("e0 m"))).alias("f"), strings.parse_bool(flag).alias("t"), strings.parse_guid(guid).alias("g"), strings.parse_int(F.concat(F.lit("-"), F.bin("p_size")), 2).alias("h"),
    )


@query("SELECT doc_id, md5(text) m, octet_length(encode(text))::INT n FROM documents")
def transcoded(spark, d):
    """UTF-16 and back."""
    t = strings.from_bytes(strings.transcode(C("text"), "UTF-16BE"), "UTF-16BE")
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("m"), strings.byte_length(t).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|\\S'))::INT n, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|\\S') \"first\" FROM (SELECT item_id doc_id, text FROM benchmark)")
def tokenised(spark, d):
    t = strings.tokens(C("text"))
    return table(spark, d, "benchmark").select(C("item_id").alias("doc_id"), F.size(t).alias("n"), F.get(t, 0).alias("first"))


@query("SELECT n_nationkey, repeat(n_name, 3) r, lpad(n_name, 15, '*') p, rpad(n_name, 15, '.') q FROM nation")
def repeated_names(spark, d):
    n = C("n_name")
    return table(spark, d, "nation").select("n_nationkey", strings.repeat(n, 3).alias("r"), strings.justify(n, 15, "right", "*").alias("p"), strings.justify(n, 15, "left", ".").alias("q"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 1e5 THEN printf('%.0fk', o_totalprice / 1e3) WHEN o_totalprice >= 1e4 THEN printf('%.1fk', o_totalprice / 1e3) WHEN o_totalprice >= 1e3 THEN printf('%.2fk', o_totalprice / 1e3)
WHEN o_totalprice >= 100 THEN printf('%.0f', o_totalprice) WHEN o_totalprice >= 10 THEN printf('%.1f', o_totalprice) ELSE printf('%.2f', o_totalprice) END s FROM (SELECT o_orderkey, floor(o_totalprice) + 0.251 o_totalprice FROM orders)""")
def si_prices(spark, d):
    return table(spark, d, "orders").select("o_orderkey", strings.si_suffix(F.floor("o_totalprice") + 0.251).alias("s"))


@query("SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') a, replace(replace(p_type, 'E', '3'), 'A', '4') b, CASE WHEN p_name = '' THEN 0 ELSE len(regexp_extract_all(p_name, '[aeiou]')) END::INT n FROM part")
def regex_replaced(spark, d):
    n = C("p_name")
    return table(spark, d, "part").select("p_partkey", regexes.replace(n, "([aeiou])", "<$1>").alias("a"), regexes.replace_set(C("p_type"), [("E", "3"), ("A", "4")]).alias("b"), F.size(regexes.capture_all(n, "[aeiou]")).alias("n"))


@query("SELECT p_partkey, regexp_matches(p_name, '(?:an|in)(?:[a-z]){1,3}e?') s, regexp_full_match(p_brand, '(?:Brand)(?:#)?[0-9]+') m, nullif(regexp_extract(p_name, '(an|in)', 1), '') g FROM part")
def regex_built(spark, d):
    """Patterns put together from parts."""
    ends = regexes.either("an", "in")
    return table(spark, d, "part").select(
        "p_partkey", regexes.search(C("p_name"), regexes.seq(ends, regexes.between("[a-z]", 1, 3), regexes.maybe("e"))).alias("s"),
        regexes.match(C("p_brand"), regexes.seq("Brand", regexes.maybe("#"), regexes.some("[0-9]"))).alias("m"), regexes.capture(C("p_name"), regexes.group(regexes.either("an", "in")), 1).alias("g"),
    )


# ------------------------------------------------------------------ dates and numbers


@query("SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)) a, (make_date(year(o_orderdate), 1, 1) + (dayofyear(o_orderdate) - 1)::INT) b, epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 n FROM orders")
def dates_built(spark, d):
    t = C("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.from_ymd(F.year(t), F.month(t), F.dayofmonth(t)).alias("a"), dates.from_year_day(F.year(t), F.dayofyear(t) - 1).alias("b"), dates.day_number(t.cast("date")).cast("long").alias("n"))


@query("SELECT event_id, (u // 86400000000)::BIGINT \"days\", (u // 3600000000)::BIGINT \"hours\", (u // 60000000)::BIGINT \"minutes\", (u // 1000000)::BIGINT \"seconds\" FROM (SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01') u FROM events)")
def duration_parts(spark, d):
    span = dates.difference_micros(C("ts"), F.lit("2000-01-01").cast("timestamp"))
    return table(spark, d, "events").select("event_id", dates.whole_days(span).alias("days"), dates.whole_hours(span).alias("hours"), dates.whole_minutes(span).alias("minutes"), dates.whole_seconds(span).alias("seconds"))


@query("SELECT event_id, strftime(ts, '%-d/%-m/%Y %H:%M') short, strftime(ts, '%A %-d %B %Y %H:%M:%S') long, strftime(ts, '%-I:%M:%S %p') h12, round(julian(ts) - 0.5, 5) j FROM events")
def dates_written(spark, d):
    t = C("ts")
    return table(spark, d, "events").select("event_id", dates.format_short(t).alias("short"), dates.format_long(t).alias("long"), dates.format_12h(t).alias("h12"), F.round(dates.julian_day(t), 5).alias("j"))


@query("SELECT event_id, event_id % 3 <> 2 ok FROM events")
def rfc3339_valid(spark, d):
    """Written as RFC 3339, every third with a month of 13."""
    month = F.when(C("event_id") % 3 == 2, "13").otherwise(F.date_format("ts", "MM"))
    text = F.concat(F.date_format("ts", "yyyy-"), month, F.date_format("ts", "-dd'T'HH:mm:ss"), F.lit(".5+01:30"))
    return table(spark, d, "events").select("event_id", dates.is_rfc3339(text).alias("ok"))


@query("SELECT p_partkey, round(ln(gamma(p_size / 10.0)), 6) g, round(lgamma(p_size / 10.0), 6) l FROM part")
def gamma_values(spark, d):
    x = C("p_size") / 10.0
    return table(spark, d, "part").select("p_partkey", F.round(F.log(maths.gamma(x)), 6).alias("g"), F.round(maths.lgamma(x), 6).alias("l"))


_SERIES = "list_sum(list_transform(range(0, 60), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1)))"


@query(f"SELECT p_partkey, round(2 / sqrt(pi()) * {_SERIES}, 6) e, round(1 - 2 / sqrt(pi()) * {_SERIES}, 6) c, round((1 + 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(x / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1)))) / 2, 5) p FROM (SELECT p_partkey, p_size / 20.0 x FROM part)")
def error_functions(spark, d):
    """erf and erfc against their series, and the normal distribution that follows."""
    x = C("p_size") / 20.0
    return table(spark, d, "part").select("p_partkey", F.round(maths.erf(x), 6).alias("e"), F.round(maths.erfc(x), 6).alias("c"), F.round(maths.normal_cdf(x), 5).alias("p"))


@query("SELECT p_partkey, round(-0.57721566490153 + list_sum(list_transform(range(1, p_size), lambda k: 1.0::DOUBLE / k)), 6) d FROM part WHERE p_size > 1")
def digamma_values(spark, d):
    """At whole numbers it is a harmonic sum."""
    return table(spark, d, "part").where("p_size > 1").select("p_partkey", F.round(maths.digamma(C("p_size").cast("double")), 6).alias("d"))


@query("SELECT p_partkey, true ok FROM part")
def quantile_inverts(spark, d):
    """The quantile of the distribution is the value again, within its error."""
    x = (C("p_size") - 25) / 12.0
    return table(spark, d, "part").select("p_partkey", maths.approx_equal(maths.normal_quantile(maths.normal_cdf(x)), x, 1e-3).alias("ok"))


@query("""SELECT p_partkey, round(degrees(p_size / 10.0), 6) deg, round((1 - t) * (1 - u) * 1 + t * (1 - u) * 2 + (1 - t) * u * 3 + t * u * 5, 6) b, round(s * s * (3 - 2 * s), 6) s, abs(t - u) <= 0.1 near
FROM (SELECT p_partkey, p_size, p_size / 50.0 t, (p_size % 7) / 7.0 u, least(greatest((p_size - 10) / 30.0, 0), 1) s FROM part)""")
def interpolated(spark, d):
    s = C("p_size")
    t, u, one = s / 50.0, (s % 7) / 7.0, lambda x: F.lit(float(x))
    return table(spark, d, "part").select("p_partkey", F.round(F.degrees(s / 10.0), 6).alias("deg"), F.round(maths.bilerp(one(1), one(2), one(3), one(5), t, u), 6).alias("b"), F.round(maths.smooth_step(s.cast("double"), 10, 40), 6).alias("s"), maths.approx_equal(t, u, 0.1).alias("near"))


@query("SELECT 1 id, 1.5::DOUBLE \"at\"")
def golden_minimum(spark, d):
    """The valley of (x - 1.5)^2."""
    at = maths.golden_section(lambda x: (x - 1.5) ** 2, -4, 7)
    return spark.range(1).select(F.lit(1).alias("id"), F.round(F.lit(at), 6).alias("at"))


_BITS = "list_sum(list_transform(range(0, 8), lambda i: ((({} >> i) & 1) << (2 * i))))"


@query(f"SELECT p_partkey, ({_BITS.format('p_size')} + 2 * {_BITS.format('(p_partkey % 200)')})::BIGINT z, round(list_sum(list_transform(range(0, 20), lambda i: (((xor(p_size, p_size >> 1) >> i) & 1) / pow(2.0, i + 1)))), 9) s FROM part")
def z_order(spark, d):
    return table(spark, d, "part").select("p_partkey", maths.morton(C("p_size"), C("p_partkey") % 200, bits=8).alias("z"), F.round(maths.sobol(C("p_size")), 9).alias("s"))


_E2 = "0.0066943799901413165"
_ECEF = f"(SELECT c_custkey, lat, lon, 6378137.0 / sqrt(1 - {_E2} * sin(radians(lat)) * sin(radians(lat))) n FROM (SELECT c_custkey, c_custkey * 7 % 160 - 80.0 lat, c_custkey * 13 % 360 - 180.0 lon FROM customer))"


@query(f"SELECT c_custkey, round((n + 100) * cos(radians(lat)) * cos(radians(lon)), 2) x, round((n + 100) * cos(radians(lat)) * sin(radians(lon)), 2) y, round((n * (1 - {_E2}) + 100) * sin(radians(lat)), 2) z, round(lat::DOUBLE, 6) back_lat, round(lon::DOUBLE, 6) back_lon, (floor((lon + 180) / 6)::INT % 60 + 1)::INT \"zone\", true same FROM {_ECEF}")
def earth_places(spark, d):
    """Degrees to earth-centred metres and back, and through UTM and back."""
    lat, lon = C("c_custkey") * 7 % 160 - 80.0, C("c_custkey") * 13 % 360 - 180.0
    c = table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))
    x, y, z = maths.to_ecef(C("lat"), C("lon"), F.lit(100.0))
    a, b, _ = maths.from_ecef(x, y, z)
    zone, east, north = maths.to_utm(C("lat"), C("lon"))
    u, v = maths.from_utm(zone, east, north, C("lat") < 0)
    same = (F.abs(u - C("lat")) < 1e-6) & (F.abs(v - C("lon")) < 1e-6)
    turned = F.when((C("lon") == -180) & (b > 0), b - 360).otherwise(b)
    return c.select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(z, 2).alias("z"), F.round(a, 6).alias("back_lat"), F.round(turned, 6).alias("back_lon"), zone.alias("zone"), same.alias("same"))


@query("SELECT n_nationkey, unnest([8, 9, 12, 13])::BIGINT v FROM nation")
def bit_permutations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(arrays.permutations(8, 0b101)).alias("v"))


# ------------------------------------------------------------------ JSON and conversions


@query("SELECT event_id, 1 n, (props::JSON->>'k')::BIGINT v, '{\"k\":' || (props::JSON->>'k') || '}' text FROM events WHERE (props::JSON->>'k') IS NOT NULL")
def json_parsed(spark, d):
    e = table(spark, d, "events").where(jsons.get(C("props"), "k").isNotNull())
    return e.select("event_id", jsons.length(C("props")).alias("n"), jsons.get(C("props"), "k", "long").alias("v"), jsons.serialise(jsons.parse(C("props"))).alias("text"))


@query("SELECT event_id, 0 pos, 'k' \"key\", props::JSON->>'k' \"value\" FROM events WHERE (props::JSON->>'k') IS NOT NULL")
def json_items(spark, d):
    return jsons.items(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "pos", "key", C("value").cast("string").alias("value"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id % 3, CASE WHEN event_id % 3 = 0 THEN event_id END, CASE WHEN event_id % 3 = 1 THEN 't' || event_id END, event_id) r, ['number', 'string', 'array'][event_id % 3 + 1] kind FROM events")
def json_order(spark, d):
    """Numbers before strings before arrays, each by its value."""
    i = C("event_id")
    text = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, F.concat(F.lit('"t'), i, F.lit('"'))).otherwise(F.concat(F.lit("["), i, F.lit("]")))
    e = table(spark, d, "events").select("event_id", text.alias("j"))
    k = e.select("event_id", jsons.kind(C("j")).alias("kind"), jsons.order_key(C("j")).alias("o")).select("event_id", "kind", C("o.kind").alias("a"), F.when(C("kind") == "number", C("o.number")).alias("b"), F.when(C("kind") == "string", C("o.text")).alias("c"))
    return ordered.with_ordinal(k, ["a", "b", "c", "event_id"], "r").select("event_id", (C("r") + 1).alias("r"), "kind")


@query("SELECT n_nationkey, 'add' op, '/a/b' path, n_name \"value\" FROM nation")
def json_patches(spark, d):
    return table(spark, d, "nation").select("n_nationkey", jsons.patch("add", "a/b", C("n_name")).alias("p")).select("n_nationkey", "p.*")


@query("SELECT event_id, '{\"k\":' || (props::JSON->>'k') || ',\"a\":{\"b\":' || event_id || '}}' j FROM events WHERE (props::JSON->>'k') IS NOT NULL")
def json_set(spark, d):
    e = table(spark, d, "events").where(jsons.get(C("props"), "k").isNotNull())
    return e.select("event_id", jsons.set_value(C("props"), F.lit("a/b"), C("event_id").cast("string")).alias("j"))


@query("SELECT vec_id, embedding[2]::DOUBLE a, label b, 3 c FROM embeddings")
def path_language(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.struct(C("embedding").alias("odd name"), F.struct(C("label").alias("b")).alias("a")).alias("r"))
    text = F.lit('{"x":[{"y z":3}]}')
    return e.select("vec_id", jsons.column_path(C("r"), "'odd name'[1]").cast("double").alias("a"), jsons.column_path(C("r"), "a.b").alias("b"), F.get_json_object(text, jsons.json_path("x[0].'y z'")).cast("int").alias("c"))


@query("SELECT c_custkey, c_nationkey::VARCHAR k, trunc(c_acctbal)::INT b, NULL::VARCHAR missing, [c_name] names FROM customer")
def structural_conversion(spark, d):
    c = table(spark, d, "customer")
    row = F.struct(C("c_nationkey").alias("k"), C("c_acctbal").alias("b"), C("c_name").alias("names"))
    source = c.select(row.alias("r")).schema["r"].dataType
    target = T.StructType([T.StructField("k", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("missing", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])
    return c.select("c_custkey", convert.structural(row, source, target).alias("r")).select("c_custkey", "r.*")


@query("SELECT n_nationkey, [n_nationkey, n_regionkey][1:1] a, list_distinct([n_regionkey, n_regionkey]) b, repeat('ab', 2) c FROM nation")
def registered_operations(spark, d):
    r = convert.default_registry()
    k, g = C("n_nationkey"), C("n_regionkey")
    return table(spark, d, "nation").select("n_nationkey", r.apply("SubArray", F.array(k, g), 0, 1).alias("a"), r.apply("UniqueArray", F.array(g, g)).alias("b"), r.apply("RepeatByte", F.lit("ab"), 2).alias("c"))


@query("""SELECT vec_id, round((0.25 * e[1] + 0.5 * e[1] + 0.25 * e[2])::DOUBLE, 6) c, round(((e[1] + e[2]) / 2)::DOUBLE, 6) m, round(e[3]::DOUBLE, 6) ch, round(e[1] + (e[2] - e[1]) * 0.5, 6) mid,
round(exp(e[1]) / list_sum(list_transform(e, lambda x: exp(x))), 6) p, round(e[1] - ln(list_sum(list_transform(e, lambda x: exp(x)))), 5) l, 5 n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings)""")
def registered_sequences(spark, d):
    """Filters and scalings of arrays by their registered names."""
    r = convert.default_registry()
    e = table(spark, d, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("e"))
    a = C("e")
    w = F.array(*map(F.lit, (0.25, 0.5, 0.25)))
    double = e.select("vec_id", "e", (2 * F.size(a) - 1).alias("size"))
    n = len(table(spark, d, "embeddings").select("embedding").first()[0])
    first = lambda c, k=0: F.round(c[k], 6)
    return double.select(
        "vec_id", first(r.apply("Convolve", a, w)).alias("c"), first(r.apply("Average", a, 3)).alias("m"), first(r.apply("GetChannel", a, 0, 2), 1).alias("ch"), first(r.apply("Resample", a, 2 * n - 1), 1).alias("mid"),
        first(r.apply("SoftMax", a)).alias("p"), F.round(r.apply("LogSoftMax", a)[0], 5).alias("l"), F.size(r.apply("Gaussian", 2, 1.0)).alias("n"),
    )


@query("SELECT n_nationkey, md5(n_name) m, n_name back, n_name secret, 'a' || chr(10) || 'b' u, 'a' || chr(13) || chr(10) || 'b' w, n_name LIKE 'A%' wild, round(sin(2 * pi() * 3 / 8), 6) s FROM nation")
def registered_texts(spark, d):
    r = convert.default_registry()
    n, key = C("n_name"), F.lit("0123456789abcdef")
    return table(spark, d, "nation").select(
        "n_nationkey", r.apply("HashMD5", n).alias("m"), r.apply("DecodeBase64", hashes.to_base64(n)).cast("string").alias("back"), r.apply("AESdecrypt", r.apply("AESencrypt", n, key), key).cast("string").alias("secret"),
        r.apply("Dos2Unix", F.lit("a\r\nb")).alias("u"), r.apply("Unix2Dos", F.lit("a\nb")).alias("w"), r.apply("WildCard", n, "A*").alias("wild"), F.round(r.apply("MakeSineWave", 8, 8)[3], 6).alias("s"),
    )


@query("SELECT n_nationkey, '{\"a\":' || n_nationkey || ',\"b\":\"' || n_name || '\"}' j, n_name back, n_nationkey <> 0 flag, 11644473600 * 10000000 + 86400::BIGINT * 10000000 * n_nationkey ticks FROM nation")
def registered_conversions(spark, d):
    r = convert.default_registry()
    k, n = C("n_nationkey"), C("n_name")
    row = F.struct(k.alias("a"), n.alias("b"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), k)
    return table(spark, d, "nation").select("n_nationkey", r.apply("EmbedAs", row).alias("j"), r.apply("LoadAs", r.apply("EmbedAs", row), "a int, b string")["b"].alias("back"), r.convert(k.cast("long"), "long", "boolean").alias("flag"), r.convert(day, "date", "filetime").alias("ticks"))


@query("SELECT event_id, n \"name\", t \"type\" FROM (SELECT event_id, unnest(['', 'a', 'b', 'c', '0']) n, unnest(['object', 'object', 'array', 'string', 'number']) t FROM events) WHERE t = 'number'")
def find_by_kind(spark, d):
    text = F.concat(F.lit('{"a":{"b":['), C("event_id"), F.lit(']},"c":"x"}'))
    return jsons.find_by_type(table(spark, d, "events").select("event_id", text.alias("j")), "j", "number").select("event_id", "name", "type")


@query("SELECT event_id, 40 depth FROM events WHERE event_id % 2 = 0")
def find_deep(spark, d):
    """A name 40 levels down."""
    text = F.when(C("event_id") % 2 == 0, F.concat(F.lit('{"a":' * 39 + '{"deep":'), C("event_id"), F.lit("}" * 40))).otherwise(F.lit("{}"))
    return jsons.find_by_name(table(spark, d, "events").select("event_id", text.alias("j")), "j", "deep").select("event_id", "depth")


_DATED = {"type": "object", "properties": {"k": {"type": "array", "items": {"type": "integer", "minimum": 5}, "uniqueItems": True}, "day": {"$ref": "#/definitions/day"}}, "additionalProperties": False, "definitions": {"day": {"type": "string", "format": "date"}}}


@query("SELECT event_id, event_id >= 5 AND event_id % 10 >= 5 AND event_id <> event_id % 10 AND event_id % 31 < 29 AND event_id % 7 <> 0 ok FROM events")
def json_schema_nested(spark, d):
    """Arrays, formats, references and members that are not listed."""
    i = C("event_id")
    text = F.concat(F.lit('{"k":['), i, F.lit(","), i % 10, F.lit('],"day":"2024-02-'), F.lpad((i % 31 + 1).cast("string"), 2, "0"), F.lit('"'), F.when(i % 7 == 0, ',"more":1').otherwise(""), F.lit("}"))
    return table(spark, d, "events").select("event_id", jsons.valid(text, _DATED).alias("ok"))


_LIST = {"$ref": "#/definitions/node", "definitions": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/definitions/node"}}}}}


@query("SELECT n_nationkey, n_regionkey <> 2 ok FROM nation")
def json_schema_recursive(spark, d):
    """A schema that refers to itself."""
    v = F.when(C("n_regionkey") == 2, '"x"').otherwise(C("n_nationkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", jsons.valid(F.concat(F.lit('{"v":1,"next":{"v":2,"next":{"v":'), v, F.lit("}}}")), _LIST).alias("ok"))


@query("SELECT p_partkey, md5(p_name) m, substr(sha256(p_name), 1, 8) s, p_name back, p_name again FROM part")
def codecs(spark, d):
    """Compressed and encrypted texts come back as they were."""
    n = C("p_name")
    packed = hashes.codec("zlib", False)(hashes.codec("zlib")(n.cast("binary"))).cast("string")
    secret = hashes.decrypt(hashes.encrypt(n, F.lit("0123456789abcdef")), F.lit("0123456789abcdef")).cast("string")
    return table(spark, d, "part").select("p_partkey", hashes.md5(n).alias("m"), F.substring(hashes.sha2(n), 1, 8).alias("s"), packed.alias("back"), secret.alias("again"))


# ------------------------------------------------------------------ streams, run on a table


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def typed_messages(spark, d):
    return stream.by_type(table(spark, d, "events"), "event_type", "click", "purchase").select("event_id", "event_type")


@query("SELECT user_id, event_type, count(*) n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def first_of_each(spark, d):
    """One row for each user and type, whichever came."""
    return stream.first_seen(table(spark, d, "events"), "ts", ["user_id", "event_type"], "1 hour").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, o_orderkey FROM events JOIN orders ON event_id = o_orderkey WHERE event_id < 500")
def keyed_lookup(spark, d):
    e = table(spark, d, "events").where("event_id < 500").select("event_id")
    return joins.lookup(e, table(spark, d, "orders").select("o_orderkey"), [("event_id", "o_orderkey")], ORDER_KEYS["orders"]).withColumn("o_orderkey", C("event_id"))
