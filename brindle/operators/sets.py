"""Set and bag algebra over DataFrames of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_previous


def concat(*parts: DataFrame, source: str | None = None) -> DataFrame:
    """All rows, by column name; with `source`, a column that says which input a row is from, as the first order key."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn(source, F.lit(i)) if source else p
        out = p if out is None else out.unionByName(p)
    return out


def distinct_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row, in the order given, of each value of `by`."""
    rest = [c for c in df.columns if c not in by]
    got = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")) if rest else df.select(*by).distinct()
    return got.select(*[F.col(c) if c in by else F.col(f"__r.{c}").alias(c) for c in df.columns])


def unique_adjacent(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    prev = with_previous(df.withColumn("__one", F.lit(1)), order, {"__v": value, "__has": "__one"})
    return prev.where(F.col("__has").isNull() | ~F.col(value).eqNullSafe(F.col("__v"))).drop("__v", "__has", "__one")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of exactly one side, by one aggregation over both."""
    both = a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.bit_or("__s").alias("__m")).where("__m < 3").drop("__m")


def complement(a: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of a that are not in the set; repeated rows stay."""
    return a.join(excluded, [a[c].eqNullSafe(excluded[c]) for c in a.columns], "left_anti")


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, subset, proper_subset, superset, proper_superset of a against b."""
    both = a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(2)))
    m = both.groupBy(*a.columns).agg(F.bit_or("__s").alias("m")).agg(F.count_if(F.col("m") == 1).alias("l"), F.count_if(F.col("m") == 2).alias("r"))
    le, ge = F.col("l") == 0, F.col("r") == 0
    return m.select((le & ge).alias("equal"), le.alias("subset"), (le & ~ge).alias("proper_subset"), ge.alias("superset"), (ge & ~le).alias("proper_superset"))


def counts(df: DataFrame) -> DataFrame:
    """A bag as its values and how often each occurs."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).unionByName(b.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    return both.groupBy(*a.columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))


def _as_counts(df: DataFrame, n) -> DataFrame:
    return df.withColumn("n", n.cast("long")).where("n > 0").drop("__a", "__b")


def bag_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts added."""
    return _as_counts(_sides(a, b), F.col("__a") + F.col("__b"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts subtracted, 0 at least."""
    return _as_counts(_sides(a, b), F.col("__a") - F.col("__b"))


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller count."""
    return _as_counts(_sides(a, b), F.least("__a", "__b"))


def bag_max(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger count."""
    return _as_counts(_sides(a, b), F.greatest("__a", "__b"))


def compare_bags(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, sub_bag, proper_sub_bag of a against b."""
    m = _sides(a, b).agg(F.coalesce(F.bool_and(F.col("__a") <= F.col("__b")), F.lit(True)).alias("le"), F.coalesce(F.bool_and(F.col("__a") == F.col("__b")), F.lit(True)).alias("eq"))
    return m.select(F.col("eq").alias("equal"), F.col("le").alias("sub_bag"), (F.col("le") & ~F.col("eq")).alias("proper_sub_bag"))


def expand(bag: DataFrame, n: str = "n") -> DataFrame:
    """A bag's values, each as often as it occurs."""
    return bag.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop("__i", n)
