"""Fluent pipelines: a DataFrame with the order of its rows, and stages that can be composed before they have an input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins, ordered, rows, sets


@dataclass(frozen=True)
class Query:
    """A table in an order. Every step gives a new Query; nothing runs until a result is asked for.

    `keys` identify a row; `by` are sort expressions put before them.
    """

    df: DataFrame
    keys: list[str]
    by: tuple[tuple[str, bool], ...] = ()

    def _with(self, df: DataFrame, **more) -> Query:
        return Query(df, more.get("keys", self.keys), more.get("by", self.by))

    def __or__(self, stage: Stage | Callable[[Query], object]):
        return stage(self)

    @property
    def order(self) -> list[str]:
        """Columns of the order where all of it ascends; descending parts are numbered first."""
        return self.keys

    def _numbered(self) -> Query:
        """This order as plain ascending keys: sort columns that descend become a rank by their opposite."""
        if not self.by:
            return self
        df, keys = self.df, []
        for i, (c, up) in enumerate(self.by):
            if up:
                keys.append(c)
            else:
                d = df.select(F.col(c).alias("__c")).distinct()
                top = ordered.with_ordinal(d, ["__c"], f"__rank{i}").select("__c", (-F.col(f"__rank{i}")).alias(f"__rank{i}"))
                df = df.join(top, F.col(c).eqNullSafe(F.col("__c"))).drop("__c")
                keys.append(f"__rank{i}")
        return Query(df, [*keys, *self.keys])

    def _ordered(self, f: Callable[[DataFrame, list[str]], DataFrame]) -> Query:
        q = self._numbered()
        out = f(q.df, q.keys)
        return self._with(out.drop(*[k for k in q.keys if k.startswith("__rank")]))

    def where(self, p: Column) -> Query:
        return self._with(rows.where(self.df, p))

    def select(self, keys: list[str] | None = None, **columns: Column) -> Query:
        """Project; the order's columns are kept unless new keys are named."""
        if keys is not None:
            return Query(rows.transform(self.df, **columns), keys)
        needed = [c for c in dict.fromkeys([*[c for c, _ in self.by], *self.keys]) if c not in columns]
        return self._with(self.df.select(*needed, *[c.alias(n) for n, c in columns.items()]))

    def take(self, n: int) -> Query:
        if self.by:
            return self._with(self.df.orderBy(*self.sort_columns()).limit(n))
        return self._with(ordered.take(self.df, n, self.keys))

    def skip(self, n: int) -> Query:
        return self._ordered(lambda d, k: ordered.skip(d, n, k))

    def take_while(self, p: Column) -> Query:
        return self._ordered(lambda d, k: ordered.take_while(d, p, k))

    def skip_while(self, p: Column) -> Query:
        return self._ordered(lambda d, k: ordered.skip_while(d, p, k))

    def order_by(self, column: str, descending: bool = False) -> Query:
        return self._with(self.df, by=((column, not descending),))

    def then_by(self, column: str, descending: bool = False) -> Query:
        return self._with(self.df, by=(*self.by, (column, not descending)))

    def sort_columns(self) -> list[Column]:
        return [*[F.col(c).asc() if up else F.col(c).desc() for c, up in self.by], *[F.col(k).asc() for k in self.keys]]

    def join(self, other: Query, on: list[tuple[str, str]]) -> Query:
        """Look up the last row of the other side for each key."""
        return self._with(joins.lookup(self.df, other.df, on, other.keys))

    def join_many(self, other: Query, on: list[tuple[str, str]]) -> Query:
        return self._with(joins.join_many(self.df, other.df, on), keys=[*self.keys, *other.keys])

    def intersect(self, other: DataFrame, on: list[tuple[str, str]]) -> Query:
        return self._with(joins.semi(self.df, other, on))

    def exclude(self, other: DataFrame, on: list[tuple[str, str]]) -> Query:
        return self._with(joins.anti(self.df, other, on))

    def concat(self, other: Query) -> Query:
        return Query(sets.concat(self.df, other.df, source="__source"), ["__source", *self.keys])

    def distinct(self, by: list[str]) -> Query:
        return self._with(sets.distinct_first(self.df, by, self.keys))

    def first(self) -> DataFrame:
        return self.take(1).df

    def at(self, i: int) -> DataFrame:
        return self.df.orderBy(*self.sort_columns()).offset(i).limit(1)

    def last(self) -> DataFrame:
        flipped = [*[F.col(c).desc() if up else F.col(c).asc() for c, up in self.by], *[F.col(k).desc() for k in self.keys]]
        return self.df.orderBy(*flipped).limit(1)

    def single(self) -> DataFrame:
        return ordered.single(self.df)

    def or_default(self, found: DataFrame, **default) -> DataFrame:
        return ordered.or_default(found, **default)

    def group_by(self, *by: str, **aggs: Column) -> Query:
        return Query(aggregates.group_by(self.df, list(by), **aggs), list(by))

    def agg(self, **aggs: Column) -> DataFrame:
        return aggregates.group_by(self.df, [], **aggs)

    def result(self) -> DataFrame:
        """The rows in order."""
        return self.df.orderBy(*self.sort_columns())


class Stage:
    """A step that waits for its input; stages combine with | into one."""

    def __init__(self, f: Callable[[Query], object]):
        self.f = f

    def __call__(self, q: Query):
        return self.f(q)

    def __or__(self, other: Stage) -> Stage:
        return Stage(lambda q: other(self(q)))


def stage(name: str, *args, **kwargs) -> Stage:
    """The step of that name with its arguments, unbound."""
    return Stage(lambda q: getattr(q, name)(*args, **kwargs))
