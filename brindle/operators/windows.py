"""Sequence operations: chunks, moving windows, filters, resampling, scaling, FFT, Kalman filter."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, with_ordinal
from .work import cut

#: Rows of a block of a large group.
BLOCK_ROWS = 50_000


def chunks(df: DataFrame, size: int, order: list[str], name: str = "chunk") -> DataFrame:
    """Number of each row's chunk of `size` rows; the last chunk may be short."""
    return with_ordinal(df, order, "__i").withColumn(name, F.floor(F.col("__i") / size).cast("long")).drop("__i")


def _blocked(df: DataFrame, by: list[str], order: list[str], before: int, after: int) -> tuple[DataFrame, list[str]]:
    """df in blocks of each group's order, and the columns that tell the blocks apart.

    A block has BLOCK_ROWS rows of its own and, with `__own` false, the rows next
    to it that a frame of so many rows before and after reaches, so that a large
    group is the work of many tasks. A table of one range needs no blocks.
    """
    if df.count() <= RANGE_ROWS:
        return df.withColumn("__own", F.lit(True)), by
    size = max(BLOCK_ROWS, 4 * (before + after))
    numbered = with_ordinal(df, order, "__o", by=by)
    k = F.floor(F.col("__o") / size)
    first, last = F.floor((F.col("__o") - after) / size), F.floor((F.col("__o") + before) / size)
    dealt = numbered.withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return dealt.withColumn("__own", F.col("__block") == k), [*by, "__block"]


def _framed(df: DataFrame, by: list[str], order: list[str], before: int, after: int, name: str, value) -> DataFrame:
    """df with a column that value(window) gives, for windows that reach so many rows before and after."""
    rows, parts = _blocked(df, by, order, before, after)
    got = rows.withColumn(name, value(Window.partitionBy(*parts).orderBy(*order))).where("__own")
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def moving(by: list[str], order: list[str], size: int):
    """A window of the last `size` rows within a group, for groups that fit a task."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)


def moving_average(df: DataFrame, value: str, by: list[str], order: list[str], size: int, name: str = "mean") -> DataFrame:
    """Mean of the last `size` rows within a group."""
    return _framed(df, by, order, size - 1, 0, name, lambda w: F.avg(value).over(w.rowsBetween(-(size - 1), 0)))


def frame_rate(df: DataFrame, ts: str, by: list[str], order: list[str], k: int, name: str = "rate") -> DataFrame:
    """Rows per second over the last k rows: k over the time since the k-th row before; null until there is one."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return _framed(df, by, order, k, 0, name, lambda w: F.try_divide(F.lit(float(k)), (t - F.lag(t, k).over(w)) / F.lit(1e6)))


def fir(df: DataFrame, value: str, taps: list[float], by: list[str], order: list[str], name: str = "filtered") -> DataFrame:
    """Weighted sum over neighbours, centred; rows beyond an end repeat the end's value."""
    o = F.struct(*order)
    ends = _stats(df, by, __head=F.min_by(value, o), __tail=F.max_by(value, o))

    def total(w) -> Column:
        out: Column = F.lit(0.0)
        for i, t in enumerate(taps):
            k = i - len(taps) // 2
            there = F.lag(F.lit(1), -k).over(w) if k < 0 else F.lead(F.lit(1), k).over(w)
            v = F.col(value) if k == 0 else F.when(there == 1, F.lag(value, -k).over(w)).otherwise(F.col("__head")) if k < 0 else F.when(there == 1, F.lead(value, k).over(w)).otherwise(F.col("__tail"))
            out = out + F.lit(float(t)) * v
        return out

    reach = len(taps) // 2
    return _framed(ends, by, order, reach, max(0, len(taps) - 1 - reach), name, total).drop("__head", "__tail")


def convolve(cells: DataFrame, kernel, axes: list[str], v: str = "v") -> DataFrame:
    """Convolution of a sparse grid of any number of dimensions with a small kernel (nested lists): each cell sends its share to its neighbours. Only cells of the input come back."""
    import numpy as np

    k = np.asarray(kernel, float)
    steps = [(tuple(i - n // 2 for i, n in zip(at, k.shape, strict=True)), float(x)) for at, x in np.ndenumerate(k) if x or not any(i - n // 2 for i, n in zip(at, k.shape, strict=True))]
    taps = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(step)], F.lit(x).alias("k"), F.lit(not any(step)).alias("own")) for step, x in steps])
    sent = cells.select(*axes, v, F.explode(taps).alias("__t"))
    moved = sent.select(*[(F.col(a) + F.col(f"__t.d{i}")).alias(a) for i, a in enumerate(axes)], (F.col(v) * F.col("__t.k")).alias(v), F.col("__t.own").alias("__own"))
    return moved.groupBy(*axes).agg(F.sum(v).alias(v), F.bool_or("__own").alias("__own")).where("__own").drop("__own")


def convolve2d(cells: DataFrame, kernel: list[list[float]], i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """Convolution of a sparse grid (i, j, v) with a small kernel: each cell sends its share to its neighbours. Only cells of the input come back."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    taps = F.array(*[F.struct(F.lit(a - h).alias("di"), F.lit(b - w).alias("dj"), F.lit(float(x)).alias("k")) for a, row in enumerate(kernel) for b, x in enumerate(row)])
    sent = cells.select(i, j, v, F.explode(taps).alias("t"))
    sent = sent.select((F.col(i) + F.col("t.di")).alias(i), (F.col(j) + F.col("t.dj")).alias(j), (F.col(v) * F.col("t.k")).alias(v), (F.col("t.di").eqNullSafe(0) & F.col("t.dj").eqNullSafe(0)).alias("own"))
    return sent.groupBy(i, j).agg(F.sum(v).alias(v), F.bool_or("own").alias("own")).where("own").drop("own")


def box_average(cells: DataFrame, width: int, height: int, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """Mean over width x height neighbours that exist, in two passes along rows and columns."""
    a = Window.partitionBy(i).orderBy(j).rangeBetween(-(width // 2), (width - 1) // 2)
    b = Window.partitionBy(j).orderBy(i).rangeBetween(-(height // 2), (height - 1) // 2)
    one = cells.withColumn("__s", F.sum(v).over(a)).withColumn("__n", F.count(v).over(a))
    return one.withColumn("mean", F.sum("__s").over(b) / F.sum("__n").over(b)).drop("__s", "__n")


def resample(df: DataFrame, position: str, value: str, ratio: float, by: list[str] | None = None) -> DataFrame:
    """Mean of the values whose position falls into each bin of width 1/ratio: bin, value."""
    by = by or []
    return df.groupBy(*by, F.floor(F.col(position) * F.lit(float(ratio))).cast("long").alias("bin")).agg(F.avg(value).alias(value))


def resample_kernel(df: DataFrame, position: str, value: str, ratio: float, reach: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Weighted mean of the values around the middle of each bin of width 1/ratio: bin, value.

    The weight falls evenly from 1 in the middle to 0 at `reach` bin widths; a
    value is sent to the bins that it reaches, and bins that none reaches are absent.
    """
    by = by or []
    x = F.col(position) * F.lit(float(ratio))
    lo, hi = F.floor(x - F.lit(reach + 0.5)).cast("long"), F.ceil(x + F.lit(reach - 0.5)).cast("long")
    sent = df.select(*by, x.alias("__x"), F.col(value).alias("__v"), F.explode(F.sequence(lo, hi)).alias("bin"))
    w = F.lit(1.0) - F.abs(F.col("__x") - F.col("bin") - 0.5) / F.lit(float(reach))
    return sent.withColumn("__w", w).where("__w > 0").groupBy(*by, "bin").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias(value))


def halve(cells: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """A grid at half its size: the mean over the cells of each block of two by two that exist."""
    return cells.groupBy(F.floor(F.col(i) / 2).cast("long").alias(i), F.floor(F.col(j) / 2).cast("long").alias(j)).agg(F.avg(v).alias(v))


def point_sample(df: DataFrame, step: int, order: list[str]) -> DataFrame:
    """Every step-th row, from the first."""
    return with_ordinal(df, order, "__i").where(F.pmod("__i", F.lit(step)) == 0).drop("__i")


#: Groups whose aggregates are broadcast.
FEW_GROUPS = 50_000


def _stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """df with aggregates of each group: combined before the shuffle, then joined back, so large groups need no sort.

    At most FEW_GROUPS groups are broadcast, so that no row moves to its group's task.
    """
    named = [a.alias(n) for n, a in aggs.items()]
    if not by:
        return df.join(F.broadcast(df.agg(*named)), F.lit(True))  # one row
    s = cut(df.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(*named))
    s = F.broadcast(s) if s.count() <= FEW_GROUPS else s.hint("merge")
    return df.join(s, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]).drop(*[f"__{b}" for b in by])


def zscore(df: DataFrame, value: str, by: list[str], name: str = "z") -> DataFrame:
    """(x - mean) / sample deviation within the group; null where that is 0 or unknown."""
    return _stats(df, by, __m=F.avg(value), __s=F.stddev_samp(value)).withColumn(name, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def rms_scale(df: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """x over the root of the group's mean square; null where that is 0 or unknown."""
    return _stats(df, by, __r=F.sqrt(F.avg(F.col(value) * F.col(value)))).withColumn(name, F.try_divide(F.col(value), F.col("__r"))).drop("__r")


def minmax_scale(df: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """(x - lo) / (hi - lo) within the group; an extent of 0 divides by 1."""
    got = _stats(df, by, __lo=F.min(value), __hi=F.max(value))
    span = F.when(F.col("__hi") == F.col("__lo"), F.lit(1.0)).otherwise(F.col("__hi") - F.col("__lo"))
    return got.withColumn(name, (F.col(value) - F.col("__lo")) / span).drop("__lo", "__hi")


def softmax(df: DataFrame, value: str, by: list[str], beta: float = 1.0, log: bool = False, name: str = "p") -> DataFrame:
    b = F.lit(float(beta)) * F.col(value)
    top = _stats(df, by, __m=F.max(b)).withColumn("__e", F.exp(b - F.col("__m")))
    got = _stats(top, by, __t=F.sum("__e"))
    p = b - F.col("__m") - F.log("__t") if log else F.col("__e") / F.col("__t")
    return got.withColumn(name, p).drop("__m", "__e", "__t")


def fft(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Discrete Fourier transform of each group's values in order: the keys, k, re, im. A group is one task's array."""
    import numpy as np
    import pandas as pd

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.fft.fft(pdf.sort_values(order)[value].to_numpy(float))
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * len(x) for b in by}, "k": np.arange(len(x)), "re": x.real, "im": x.imag})

    return df.groupBy(*by).applyInPandas(run, ", ".join([f"{b} {types[b]}" for b in by]) + ", k long, re double, im double")


def extended_kalman(df: DataFrame, values: list[str], by: list[str], order: list[str], move, move_slope, see, see_slope, process, noise, start, spread) -> DataFrame:
    """Extended Kalman filter along each group: df's keys, order and values with the state and its variances after each row.

    move(x) is the next state and see(x) the measurement that a state should
    give; move_slope and see_slope are their Jacobians; process and noise are the
    covariances, start and spread the first state and its covariance. The values
    of a row are one measurement; a row with a null in them only moves the state.
    One pass in order; the state of one group is held at a time.
    """
    import numpy as np
    import pandas as pd

    cols = [*dict.fromkeys([*by, *order, *values])]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = df.select(*cols).repartition(*by).sortWithinPartitions(*by, *order)
    q, r, x0, p0 = (np.atleast_2d(np.asarray(m, float)) for m in (process, noise, np.asarray(start, float).reshape(-1, 1), spread))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, p = None, x0, p0
        for b in batches:
            states, variances = [], []
            for k, z in zip(b[by].itertuples(index=False, name=None), b[values].to_numpy(float), strict=True):
                if k != key:
                    key, x, p = k, x0, p0
                f = np.atleast_2d(move_slope(x))
                x, p = np.asarray(move(x), float).reshape(-1, 1), f @ p @ f.T + q
                if not np.isnan(z).any():
                    h = np.atleast_2d(see_slope(x))
                    gain = np.linalg.solve((h @ p @ h.T + r).T, (p @ h.T).T).T
                    x = x + gain @ (z.reshape(-1, 1) - np.asarray(see(x), float).reshape(-1, 1))
                    p = (np.eye(len(x)) - gain @ h) @ p
                states.append(x.ravel().tolist())
                variances.append(np.diag(p).tolist())
            yield b.assign(state=states, variance=variances)

    return parts.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in cols) + ", state array<double>, variance array<double>")


def kalman(df: DataFrame, value: str, by: list[str], order: list[str], process: float, noise: float) -> DataFrame:
    """Constant-level Kalman filter along each group: df's rows with estimate and variance, one pass in order with bounded state."""
    import pandas as pd

    cols = [*dict.fromkeys([*by, *order, value])]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = df.select(*cols).repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, p = None, 0.0, 0.0
        for b in batches:
            est, var = [], []
            for k, z in zip(b[by].itertuples(index=False, name=None), b[value].to_numpy(float), strict=True):
                if k != key:
                    key, x, p = k, z, noise
                else:
                    p += process
                    gain = p / (p + noise)
                    x, p = x + gain * (z - x), (1 - gain) * p
                est.append(x)
                var.append(p)
            yield b.assign(estimate=est, variance=var)

    return parts.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in cols) + ", estimate double, variance double")
