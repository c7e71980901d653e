"""Folds over a whole input or by key: counts, sums, statistics, best rows, collections, dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_ordinal
from .rows import holds


def group_by(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by key, or over everything without one; partial sums are combined before the shuffle."""
    named = [a.alias(n) for n, a in aggs.items()]
    return df.groupBy(*by).agg(*named) if by else df.agg(*named)


def count(p: Column | None = None) -> Column:
    return F.count("*") if p is None else F.count_if(holds(p))


def total(c: Column) -> Column:
    """Sum, 0 for nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def average(c: Column, truncate: bool = False) -> Column:
    """Mean; with truncate, whole sum divided by count towards zero."""
    if not truncate:
        return F.avg(c)
    whole = F.sum(c.cast("decimal(38,0)"))  # exact beyond 2^53
    return F.call_function("div", whole, F.nullif(F.count(c), F.lit(0)).cast("decimal(20,0)")).cast("long")


def contains(c: Column, value) -> Column:
    return F.coalesce(F.bool_or(c.eqNullSafe(F.lit(value))), F.lit(False))


def all_of(p: Column) -> Column:
    return F.coalesce(F.bool_and(holds(p)), F.lit(True))


def any_of(p: Column) -> Column:
    return F.coalesce(F.bool_or(holds(p)), F.lit(False))


def none_of(p: Column) -> Column:
    return ~any_of(p)


def approx_distinct(c: Column, error: float = 0.05) -> Column:
    """Distinct values within a relative standard error, by a mergeable sketch of fixed size."""
    return F.approx_count_distinct(c, error)


def approx_quantiles(c: Column, shares: list[float], accuracy: int = 10_000) -> Column:
    """An array of quantiles whose ranks are off by at most 1 / accuracy of all values."""
    return F.percentile_approx(c, F.array(*[F.lit(float(s)) for s in shares]), F.lit(accuracy))


def cube(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by every subset of the keys; keys left out are null."""
    return df.cube(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def rollup(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by every leading part of the keys; keys left out are null."""
    return df.rollup(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def pivot(df: DataFrame, by: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """One row for each key and one column for each of the stated values of another column."""
    return df.groupBy(*by).pivot(column, values).agg(agg)


def argmax(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The row of the largest value, the first of equal ones."""
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *order).limit(1)


def argmin(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).asc(), *order).limit(1)


def extent(c: Column) -> list[Column]:
    return [F.min(c).alias("lo"), F.max(c).alias("hi")]


def statistics(c: Column) -> dict[str, Column]:
    """n, mean, variance by n - 1, its root, rms, min and max; a variance of one value is null."""
    return {"n": F.count(c), "mean": F.avg(c), "variance": F.var_samp(c), "sigma": F.stddev_samp(c), "rms": F.sqrt(F.avg(c * c)), "lo": F.min(c), "hi": F.max(c)}


def weighted(c: Column, weight: Column) -> dict[str, Column]:
    """Weighted mean and variance, a weight counting as so many values."""
    w, wx, wxx = F.sum(weight), F.sum(weight * c), F.sum(weight * c * c)
    return {"mean": F.try_divide(wx, w), "variance": F.try_divide(wxx - F.try_divide(wx * wx, w), w - 1)}


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population covariance of every pair, one row each: a, b, cov."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)]
    cells += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs) if a != b]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def fold(df: DataFrame, by: list[str], value: str, order: list[str], init: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """An ordered fold within each group, for steps that no aggregate has. A group's values meet in one task: keep groups bounded."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    got = df.groupBy(*by).agg(rows.alias("__rows")) if by else df.agg(rows.alias("__rows"))
    return got.select(*by, F.aggregate("__rows", init, lambda a, x: step(a, x["__v"])).alias("result"))


def group_collect(df: DataFrame, by: list[str], value: str, order: list[str], name: str = "values") -> DataFrame:
    """Values of each key as an array in order."""
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]).alias(name))


def group_last(df: DataFrame, by: list[str], value: str, order: list[str], name: str = "last") -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(name))


def dictionary(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values numbered from 0 by first occurrence: value, id."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("__f"))
    return with_ordinal(first, ["__f"], "id").select(value, "id")


def encode(df: DataFrame, value: str, order: list[str], name: str = "id") -> DataFrame:
    """df with the number of each value in its dictionary."""
    d = dictionary(df, value, order).select(F.col(value).alias("__v"), F.col("id").alias(name))
    return df.join(d, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def snapshot_delta(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Differences of counters between two snapshots by key; a key missing on one side counts as 0 there."""
    b = before.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(v).alias(f"__b_{v}") for v in values])
    got = after.join(b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)], "full_outer")
    return got.select(*[F.coalesce(F.col(k), F.col(f"__k{i}")).alias(k) for i, k in enumerate(key)], *[(F.coalesce(F.col(v), F.lit(0)) - F.coalesce(F.col(f"__b_{v}"), F.lit(0))).alias(v) for v in values])
