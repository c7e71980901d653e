"""Joins: last-wins lookup, semi, anti, zip, as-of, interval overlap, nearest neighbour, by name hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranged, with_ordinal
from .rows import holds
from .work import cut


def lookup(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], right_order: list[str]) -> DataFrame:
    """Each left row with the last right row of its key; left rows without one go.

    The last row per key is a partial aggregate, so hot keys are combined before
    they are shuffled; Spark broadcasts the side that it measures as small.
    """
    keys = [r for _, r in on]
    rest = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*right_order)).alias("__row")) if rest else right.select(*keys).distinct()
    flat = last.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
    return left.join(flat, [F.col(a) == F.col(b) for a, b in on], "inner")


def join_many(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An ordinary N:M equi-join."""
    return left.join(right, [F.col(a) == F.col(b) for a, b in on], how)


def semi(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Left rows with a partner; repeated left rows stay."""
    return left.join(right.select(*[b for _, b in on]), [F.col(a).eqNullSafe(F.col(b)) for a, b in on], "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Left rows without a partner; repeated left rows stay."""
    return left.join(right.select(*[b for _, b in on]), [F.col(a).eqNullSafe(F.col(b)) for a, b in on], "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str = "left") -> DataFrame:
    """The i-th row of one with the i-th of the other; as long as the left one."""
    a = with_ordinal(left, left_keys, "__i")
    b = with_ordinal(right, right_keys, "__j")
    return a.join(b, F.col("__i") == F.col("__j"), how).drop("__i", "__j")


def _pairs(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """The i-th rows of both, with i as `ord`, as far as the shorter one goes."""
    return with_ordinal(left, left_keys, "ord").join(with_ordinal(right, right_keys, "__j"), F.col("ord") == F.col("__j")).drop("__j")


def find_if2(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], p: Column) -> DataFrame:
    """The first pair of i-th rows for which p holds, with its place as `ord`."""
    got = _pairs(left, right, left_keys, right_keys)
    return got.where(holds(p)).orderBy("ord").limit(1)


def all_of2(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], p: Column) -> DataFrame:
    """One row, `all`: whether p holds for every pair of i-th rows; true without one."""
    return _pairs(left, right, left_keys, right_keys).agg(F.coalesce(F.bool_and(holds(p)), F.lit(True)).alias("all"))


def any_of2(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], p: Column) -> DataFrame:
    """One row, `any`: whether p holds for some pair of i-th rows."""
    return _pairs(left, right, left_keys, right_keys).agg(F.coalesce(F.bool_or(holds(p)), F.lit(False)).alias("any"))


def none_of2(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], p: Column) -> DataFrame:
    """One row, `none`: whether p holds for no pair of i-th rows."""
    return any_of2(left, right, left_keys, right_keys, p).select((~F.col("any")).alias("none"))


def lower_bound(probe: DataFrame, keys: DataFrame, at: str, key: str, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """For each probe row, the smallest key >= (or, if strict, >) its value, as column `bound`; null without one.

    `by` are columns of both sides that must be equal. The inputs are merged, the
    order is cut into ranges, each is read once in order within a group of `by`,
    and what lies beyond a range comes from the ranges after it.
    """
    return _as_of(probe, keys, at, key, by or [], strict, forward=True)


def as_of(probe: DataFrame, keys: DataFrame, at: str, key: str, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """For each probe row, the greatest key <= (or <) its value, as column `bound`."""
    return _as_of(probe, keys, at, key, by or [], strict, forward=False)


def _as_of(probe: DataFrame, keys: DataFrame, at: str, key: str, by: list[str], strict: bool, forward: bool) -> DataFrame:
    after = int(forward != strict)  # whether keys stand behind probe rows of the same value
    kind = keys.schema[key].dataType
    p = probe.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(at).cast(kind).alias("__t"), F.lit(1 - after).alias("__tie"), F.struct(*probe.columns).alias("__row"))
    k = keys.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(key).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    k = k.withColumn("__tie", F.lit(after)).withColumn("__row", F.lit(None).cast(p.schema["__row"].dataType)).withColumn("__key", F.col("__t"))
    both = p.withColumn("__key", F.lit(None).cast(kind)).unionByName(k)
    done = _as_of_ranges(both, [f"__by{i}" for i in range(len(by))], forward)
    out = done.where(F.col("__row").isNotNull())
    # a null probe value has no bound
    return out.select("__row.*", F.when(F.col("__t").isNotNull(), F.col("__b")).alias("bound"))


def _as_of_ranges(both: DataFrame, groups: list[str], forward: bool) -> DataFrame:
    """The nearest key within a range of the order, or else the edge of the nearest range with one; a large group is the work of many tasks."""
    rows = ranged(both, ["__t"], "__r")
    # both ways by frames that begin at the first row: Spark evaluates one that ends at the last row anew for each row
    way = (lambda c: F.col(c).desc()) if forward else F.col
    w = Window.partitionBy(*groups, "__r").orderBy(way("__t"), way("__tie")).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("__key", ignorenulls=True).over(w)
    edge = rows.groupBy(*groups, "__r").agg((F.min("__key") if forward else F.max("__key")).alias("__e"))  # a row for each range, in each group
    o = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(way("__r")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = (F.min if forward else F.max)("__e").over(o)
    far = edge.select(*[F.col(g).alias(f"{g}q") for g in groups], F.col("__r").alias("__q"), beyond.alias("__far"))
    same = F.col("__r") == F.col("__q")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}q"))
    return rows.withColumn("__n", near).join(far if groups else F.broadcast(far), same).withColumn("__b", F.coalesce("__n", "__far"))


def interval_overlap(left: DataFrame, right: DataFrame, l_lo: str, l_hi: str, r_lo: str, r_hi: str, width: float, strict: bool = False) -> DataFrame:
    """Pairs whose intervals overlap; closed ends, or open ones if strict. Intervals with lo > hi overlap as the comparison of ends says.

    Every interval is put into the cells of `width` that it touches, cells are
    joined, and a pair is kept in the first cell both touch. `width` should be
    near the usual length of the intervals. A merge join, as Spark may take the
    exploded left side for small and broadcast it. It streams the right rows:
    all left partners of a right row follow each other, so that Parquet keeps
    the columns of the right side as runs and repeated partners compress.
    """

    def cells(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
        a, b = F.least(lo, hi), F.greatest(lo, hi)
        at = lambda c: F.floor(c.cast("double") / F.lit(float(width))).cast("long")
        return df.select("*", F.posexplode(F.sequence(at(a), at(b))).alias(f"__{name}0", f"__{name}")).withColumn(f"__{name}0", F.col(f"__{name}0") == 0)

    a, b = cells(left, l_lo, l_hi, "l"), cells(right, r_lo, r_hi, "r")
    meets = ~((F.col(r_hi) < F.col(l_lo)) | (F.col(l_hi) < F.col(r_lo))) if not strict else (F.col(l_lo) < F.col(r_hi)) & (F.col(r_lo) < F.col(l_hi))
    first = F.col("__l0") | F.col("__r0")  # a cell of both is the first one if it is the first of either
    got = b.join(a.hint("merge"), (F.col("__l") == F.col("__r")) & meets & first).drop("__l", "__r", "__l0", "__r0")
    n, m = len(left.columns), len(right.columns)
    got = got.toDF(*[f"__{i}" for i in range(m + n)])  # by place, as both sides may have a name
    names = [*left.columns, *right.columns]
    return got.select(*[F.col(f"__{(m + i) if i < n else i - n}").alias(c) for i, c in enumerate(names)])


#: Cells of the nearest neighbour search, and points of one task's part of a cell.
PIVOTS, CELL_ROWS = 256, 50_000


def nearest(queries: DataFrame, points: DataFrame, vector: str, query_id: str, point_id: str, point_vector: str, other: bool = False, most: float | None = None) -> DataFrame:
    """Nearest point of every query by squared distance, ties to the smaller id: query_id, point_id, dist2.

    With `other`, a point of the query's own id does not count; with `most`, only
    points within that distance do. Points go to the cell of their nearest pivot,
    of PIVOTS pivots from a bounded sample. A query looks into its own cell first,
    and then only into cells that may hold something as near by the triangle
    inequality. Large cells are dealt over many tasks; nulls take no part. At most
    CELL_ROWS points in all are broadcast to the queries instead.
    """
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession
    qt, pt = queries.schema[query_id].dataType.simpleString(), points.schema[point_id].dataType.simpleString()
    ps = points.select(F.col(point_id).alias("p"), F.col(point_vector).cast("array<double>").alias("x")).where("p IS NOT NULL AND x IS NOT NULL")
    qs = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("y")).where("q IS NOT NULL AND y IS NOT NULL").dropDuplicates(["q"])
    out = f"q {qt}, p {pt}, dist2 double"

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of some points, in order of their ids, for each of some queries."""
        rows = []
        x, ids = np.stack(right.x.to_numpy()), right.p.to_numpy()
        xx = (x * x).sum(1)
        for at in range(0, len(left), 256):
            y, q = np.stack(left.y.to_numpy()[at : at + 256]), left.q.to_numpy()[at : at + 256]
            approx = (y * y).sum(1)[:, None] - 2 * y @ x.T + xx[None]
            if other:
                approx[q[:, None] == ids[None]] = np.inf
            edge = approx.min(1)
            for i in np.flatnonzero(np.isfinite(edge)):
                near = np.flatnonzero(approx[i] <= edge[i] + 1e-6 * (1 + abs(edge[i]) + xx.max()))
                d = ((x[near] - y[i]) ** 2).sum(1)  # exactly, for those in question
                k = int(d.argmin())
                if most is None or d[k] <= float(most) ** 2:
                    rows.append((q[i], ids[near[k]], float(d[k])))
        return pd.DataFrame(rows, columns=["q", "p", "dist2"])

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("q").alias(query_id), F.col("p").alias(point_id), "dist2")

    few = ps.limit(CELL_ROWS + 1).toPandas()
    if len(few) <= CELL_ROWS:  # so few go to the queries as they are
        if not len(few):
            return named(spark.createDataFrame([], out))
        held = spark.sparkContext.broadcast(few.sort_values("p"))

        def each(batches):
            for b in batches:
                if len(b):
                    yield closest(b, held.value)

        return named(qs.mapInPandas(each, out))
    chosen = [r[0] for r in ps.orderBy(F.xxhash64("p"), "p").limit(PIVOTS).select("x").collect()]  # PIVOTS vectors
    sent = spark.sparkContext.broadcast(np.array(chosen))

    def distances(y: np.ndarray) -> np.ndarray:
        c = sent.value
        return np.sqrt(np.maximum((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)[None], 0))

    def place(batches):
        for b in batches:
            if len(b):
                d = distances(np.stack(b.x.to_numpy()))
                yield b.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1))

    placed = cut(ps.mapInPandas(place, f"p {pt}, x array<double>, cell int, far double"))
    sizes = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # PIVOTS rows
    radius = np.array([sizes[c][1] if c in sizes else -np.inf for c in range(len(chosen))])
    parts = F.create_map(*[x for c, (n, _) in sizes.items() for x in (F.lit(c), F.lit(-(-n // CELL_ROWS)))])
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("p"), parts[F.col("cell")]).cast("int")).select("p", "x", "cell", "part")

    def visits(first: bool):
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                d = distances(np.stack(b.y.to_numpy()))
                own = np.where(np.isfinite(radius)[None], d, np.inf).argmin(1)
                bound = np.full(len(b), np.inf) if first else np.sqrt(b.best.fillna(np.inf).to_numpy(float))
                if most is not None:
                    bound = np.minimum(bound, most)
                near = np.arange(len(radius))[None] == own[:, None]
                if not first:
                    near = ~near & (d - radius[None] <= bound[:, None] * (1 + 1e-9) + 1e-6)
                yield pd.DataFrame({"q": b.q, "y": b.y, "cells": [np.flatnonzero(r & np.isfinite(radius)).astype(np.int32) for r in near]})

        return run

    def search(rows: DataFrame, first: bool) -> DataFrame:
        to = rows.mapInPandas(visits(first), f"q {qt}, y array<double>, cells array<int>").select("q", "y", F.explode("cells").alias("cell"))
        to = to.select("q", "y", "cell", F.explode(F.sequence(F.lit(0), (parts[F.col("cell")] - 1).cast("int"))).alias("part"))

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return closest(left, right.sort_values("p")) if len(left) and len(right) else pd.DataFrame(columns=["q", "p", "dist2"])

        return to.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(best, out)

    one = cut(search(qs, True))
    bound = one.groupBy("q").agg(F.min("dist2").alias("best"))
    more = search(qs.join(bound, "q", "left"), False)
    ends = one.unionByName(more).groupBy("q").agg(F.min(F.struct("dist2", "p")).alias("b"))
    return named(ends.select("q", "b.p", "b.dist2"))


def within(left: DataFrame, right: DataFrame, coords: list[tuple[str, str]], distance: float) -> DataFrame:
    """Pairs of points within a distance, by grid cells of that size: a left point looks up its own and the adjoining cells.

    A merge join, as Spark may take either side for small and broadcast it.
    """
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(distance))).cast("long")
    a = left
    for i, (lc, _) in enumerate(coords):
        a = a.withColumn(f"__c{i}", F.explode(F.array(*[cell(lc) + F.lit(d) for d in (-1, 0, 1)])))
    b = right
    for i, (_, rc) in enumerate(coords):
        b = b.withColumn(f"__d{i}", cell(rc))
    dist2: Column = F.lit(0.0)
    for lc, rc in coords:
        dist2 = dist2 + (F.col(lc) - F.col(rc)) * (F.col(lc) - F.col(rc))
    same = [F.col(f"__c{i}") == F.col(f"__d{i}") for i in range(len(coords))]
    got = a.join(b.hint("merge"), same).withColumn("dist2", dist2).where(F.col("dist2") <= F.lit(float(distance) ** 2))
    return got.drop(*[f"__c{i}" for i in range(len(coords))], *[f"__d{i}" for i in range(len(coords))])


def by_name_hash(left: DataFrame, right: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids that are CRC-32 values with the texts they stand for."""
    return left.join(right.withColumn("__crc", F.crc32(F.col(text_col).cast("binary"))), F.col(id_col) == F.col("__crc"), "left").drop("__crc")
