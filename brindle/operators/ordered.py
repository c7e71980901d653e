"""Operators that need an order: ordinals, skip, take, elements, slices, runs and medians.

All take the columns of the order explicitly; these should identify a row. None
of them moves a whole table into one partition: limits use Spark's bounded
top-n, leading runs compare with one boundary, and ordinals are counted by
ranges of the order, whose number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import holds
from .work import cut

#: Rows of one range when ordinals are counted.
RANGE_ROWS = 200_000
#: Up to so many ranges are literals of the plan; more come from Spark's range partitioning, up to MOST_RANGES.
MAX_RANGES = 400
MOST_RANGES = 100_000
_SAMPLE = 50


def _struct(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def _sort(keys: list[str], desc: bool = False) -> list[Column]:
    return [F.col(k).desc() if desc else F.col(k).asc() for k in keys]


def _bounds(df: DataFrame, keys: list[str], n: int) -> Column | None:
    """n - 1 boundaries of the order as a literal array, from a sample of bounded size."""
    if n <= 1:
        return None
    rows = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(n * _SAMPLE).collect()  # MAX_RANGES x _SAMPLE rows at most
    rows = sorted({tuple(r) for r in rows}, key=lambda r: tuple((x is not None, x) for x in r))
    chosen = [rows[i * len(rows) // n] for i in range(1, n)] if rows else []
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.array(*[F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, r, strict=True)]) for r in chosen]) if chosen else None


def ranged(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the number of the range of the order that a row is in; rows of equal keys are in one.

    Ranges hold about RANGE_ROWS rows. A few are cut by boundaries that are
    literals of the plan. Many come from range partitioning, whose sample differs
    from run to run, so the rows are written to a work table with their range.
    """
    n = min(MOST_RANGES, df.count() // RANGE_ROWS + 1)
    if n > MAX_RANGES:
        return cut(df.repartitionByRange(n, *keys).withColumn(name, F.spark_partition_id()))
    bounds = _bounds(df, keys, n)
    return df.withColumn(name, F.lit(0) if bounds is None else F.size(F.filter(bounds, lambda b: b <= _struct(keys))))


def with_ordinal(df: DataFrame, keys: list[str], name: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Number the rows from 0 in the order of keys, over the whole table or within each group of `by`.

    Rows are numbered within their range of the order, and shifted by the rows of
    the ranges before; a group is cut by the same ranges, so that a large one is
    the work of many tasks.
    """
    by = by or []
    r, local, shift, n = (_unused(df, x) for x in ("__range", "__local", "__shift", "__n"))
    sides = {c: _unused(df, f"__by{i}") for i, c in enumerate(by)}
    rows = ranged(df, keys, r).withColumn(local, F.row_number().over(Window.partitionBy(*by, r).orderBy(*_sort(keys))) - 1)
    counts = rows.groupBy(*by, r).agg(F.count("*").alias(n))
    before = Window.partitionBy(*by).orderBy(r) if by else Window.orderBy(r)  # as many rows as ranges, for each group
    counts = counts.select(*[F.col(c).alias(s) for c, s in sides.items()], F.col(r).alias(r + "r"), F.coalesce(F.sum(n).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(shift))
    same = F.col(r) == F.col(r + "r")
    for c, s in sides.items():
        same = same & F.col(c).eqNullSafe(F.col(s))
    got = rows.join(counts if by else F.broadcast(counts), same)  # MOST_RANGES rows at most
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(shift) + F.col(local)).cast("long").alias(name))


def _unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, beginning with the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def take(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*_sort(keys)).limit(n)


def skip(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """All but the first n rows; empty if there are no more. The n-th row, found by a bounded top-n, is the boundary; a far one by its ordinal."""
    if n <= 0:
        return df
    if n > TOP_ROWS:
        o = _unused(df, "__ord")
        return with_ordinal(df, keys, o).where(F.col(o) >= n).drop(o)
    edge = df.select(_struct(keys).alias("__k")).orderBy("__k").limit(n).agg(F.max("__k").alias("__edge"))  # one row
    return df.join(F.broadcast(edge), _struct(keys) > F.col("__edge"), "inner").drop("__edge")


def _stop(df: DataFrame, p: Column, keys: list[str]) -> DataFrame:
    """The first row for which p fails, as one row; null if it never does."""
    return df.filter(~holds(p)).agg(F.min(_struct(keys)).alias("__stop"))


def take_while(df: DataFrame, p: Column, keys: list[str]) -> DataFrame:
    """The leading rows for which p holds."""
    return df.join(F.broadcast(_stop(df, p, keys)), F.col("__stop").isNull() | (_struct(keys) < F.col("__stop"))).drop("__stop")


def skip_while(df: DataFrame, p: Column, keys: list[str]) -> DataFrame:
    """All from the first row for which p fails; empty if it never does."""
    return df.join(F.broadcast(_stop(df, p, keys)), _struct(keys) >= F.col("__stop")).drop("__stop")


def first(df: DataFrame, keys: list[str]) -> DataFrame:
    return take(df, 1, keys)


def last(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*_sort(keys, True)).limit(1)


#: Rows that a bounded top-n may hold in a task; further on ordinals are counted.
TOP_ROWS = 100_000


def _between(df: DataFrame, start: int, end: int, keys: list[str]) -> DataFrame:
    """Rows start to end - 1."""
    if end <= TOP_ROWS:
        return df.orderBy(*_sort(keys)).offset(start).limit(max(0, end - start))
    o = _unused(df, "__ord")
    return with_ordinal(df, keys, o).where((F.col(o) >= start) & (F.col(o) < end)).drop(o)


def at(df: DataFrame, i: int, keys: list[str]) -> DataFrame:
    """The row with 0-based index i."""
    return _between(df, i, i + 1, keys)


def or_default(df: DataFrame, **default) -> DataFrame:
    """df, or one row of default values where it is empty; columns not named are null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    one = df.sparkSession.range(1).select(*[F.lit(default.get(c)).cast(t).alias(c) for c, t in types.items()])
    some = df.limit(1).select(F.lit(1).alias("__some"))
    return df.unionByName(one.join(F.broadcast(some), F.lit(True), "left_anti"))


def first_or_default(df: DataFrame, keys: list[str], **default) -> DataFrame:
    return or_default(first(df, keys), **default)


def last_or_default(df: DataFrame, keys: list[str], **default) -> DataFrame:
    return or_default(last(df, keys), **default)


def at_or_default(df: DataFrame, i: int, keys: list[str], **default) -> DataFrame:
    return or_default(at(df, i, keys), **default)


def single(df: DataFrame) -> DataFrame:
    """The only row; running it raises if there is none or more than one."""
    found = df.limit(2).agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    return found.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("exactly one row is wanted"))).alias("row")).select("row.*")


def single_or_default(df: DataFrame, **default) -> DataFrame:
    """The only row, or the default for none or more than one."""
    found = df.limit(2).agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    return or_default(found.where("n = 1").select("row.*"), **default)


def slice_rows(df: DataFrame, keys: list[str], start: int, end: int | None = None) -> DataFrame:
    """Rows from start up to end, 0-based; negative numbers count from the end."""
    if start >= 0 and end is not None and end >= 0:
        return _between(df, start, max(start, end), keys)
    if start >= 0 and end is None:
        return skip(df, start, keys)
    if start < 0 and end is None:
        return df.orderBy(*_sort(keys, True)).limit(-start)
    n = df.count()
    a, b = (x + n if x < 0 else x for x in (start, end if end is not None else n))
    a, b = max(0, a), max(0, b)
    return _between(df, a, max(a, b), keys)


def find(df: DataFrame, p: Column, keys: list[str]) -> DataFrame:
    """The first row for which p holds."""
    return first(df.filter(holds(p)), keys)


def top_n(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The n first rows by any sort expressions, as a bounded heap in every task."""
    return df.orderBy(*by).limit(n)


def upper_median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The element at index count // 2 in the order of value, without interpolation; one row, none for an empty input.

    Index i of a sorted column is its smallest value with more than i values up
    to it, so counts of equal values are all that moves.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).count()
    ranked = with_running(counts, value, "count")
    total = counts.agg((F.floor(F.sum("count") / 2)).alias("__mid"))
    return ranked.join(F.broadcast(total), F.col("__upto") > F.col("__mid")).agg(F.min(value).alias(value)).where(F.col(value).isNotNull())


def with_running(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running total of value up to each key, with keys unique, by ranges as in with_ordinal."""
    rows = ranged(df, [key], "__range")
    local = F.sum(value).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy("__range").agg(F.sum(value).alias("s"))
    shift = sums.select(F.col("__range").alias("__r"), F.coalesce(F.sum("s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    return rows.withColumn("__l", local).join(F.broadcast(shift), F.col("__range") == F.col("__r")).withColumn("__upto", F.col("__shift") + F.col("__l")).drop("__range", "__r", "__shift", "__l")


def with_previous(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Values of the row before, {new column: column}, over the whole order; found by its ordinal."""
    numbered = with_ordinal(df, keys, "__o")
    before = numbered.select((F.col("__o") + 1).alias("__p"), *[F.col(c).alias(n) for n, c in columns.items()])
    return numbered.join(before, F.col("__o") == F.col("__p"), "left").drop("__o", "__p")


def leading_run(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """run_length: how many leading rows are in ascending order of value; is_sorted: whether all are."""
    prev = with_previous(with_ordinal(df, keys, "__i"), keys, {"__v": value})
    drop = holds(F.col(value) < F.col("__v"))
    return prev.agg(F.coalesce(F.min(F.when(drop, F.col("__i"))), F.count("*")).alias("run_length"), (F.count_if(drop) == 0).alias("is_sorted"))


def reverse(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*_sort(keys, True))


def rotate(df: DataFrame, by: int, keys: list[str], name: str = "ord") -> DataFrame:
    """Ordinals after moving the first `by` rows to the end."""
    n = df.count()
    return with_ordinal(df, keys, name).withColumn(name, F.pmod(F.col(name) - F.lit(by), F.lit(max(1, n))))


def shuffle(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """A fixed random order for a seed and the rows' keys, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), *_sort(keys))


def order_by(df: DataFrame, *by: Column, keys: list[str]) -> DataFrame:
    """Sorted by the given expressions, ties by the keys: stable."""
    return df.orderBy(*by, *_sort(keys))


def merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two ordered inputs as one; on ties rows of the right one come first."""
    both = right.withColumn("__side", F.lit(0)).unionByName(left.withColumn("__side", F.lit(1)))
    return both.orderBy(*_sort(keys), "__side").drop("__side")
