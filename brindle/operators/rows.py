"""Sources, projection, filters and composition of stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce as _reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def holds(p: Column) -> Column:
    """A predicate without a third value: null counts as false."""
    return F.coalesce(p, F.lit(False))


def compose(*stages: Stage) -> Stage:
    """One stage of several, applied from left to right."""
    return lambda df: _reduce(lambda d, f: f(d), stages, df)


def int_range(spark: SparkSession, start: int, end: int | None = None, inclusive: bool = False, name: str = "x") -> DataFrame:
    """Integers from start to end, or from 0 to start."""
    a, b = (0, start) if end is None else (start, end)
    return spark.range(a, b + inclusive).select(F.col("id").alias(name))


def repeat(spark: SparkSession, value, n: int, name: str = "x") -> DataFrame:
    """The same value n times."""
    return spark.range(n).select(F.lit(value).alias(name))


def where(df: DataFrame, p: Column) -> DataFrame:
    return df.filter(holds(p))


def where_compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Filter by comparing a column with a bound value: one of < <= > >= == !=."""
    c, v = F.col(column), F.lit(value)
    made = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "==": c == v, "!=": c != v}
    return where(df, made[op])


def remove(df: DataFrame, p: Column) -> DataFrame:
    """Rows for which p does not hold."""
    return df.filter(~holds(p))


def partition(df: DataFrame, p: Column, flag: str = "matched") -> DataFrame:
    """All rows with a flag that sorts those without p first."""
    return df.withColumn(flag, holds(p))


def split(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without p, and rows with it."""
    return remove(df, p), where(df, p)


def transform(df: DataFrame, **columns: Column) -> DataFrame:
    """A row for each row, of the given expressions."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows one after another, a partition at a time in the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def to_array(df: DataFrame) -> pa.Table:
    """Everything in the driver: for small results."""
    return df.toArrow()


def for_each(df: DataFrame, f: Callable[[Iterator[Row]], None]) -> None:
    """Visit every row on the executors, a partition at a time."""
    df.foreachPartition(f)
