"""Arrays and maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub_array(a: Column, start: int, size: int = 0) -> Column:
    """`size` elements from a 0-based start; size 0 means to the end."""
    return F.slice(a, start + 1, F.lit(size) if size else F.greatest(F.size(a) - start, F.lit(0)))


def unique_array(a: Column) -> Column:
    return F.array_distinct(a)


def append_array(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def slice_array(a: Column, start: int, end: int | None = None) -> Column:
    """Elements from start up to end; negative numbers count from the end."""
    n = F.size(a)
    at = lambda i: F.greatest(F.lit(0), n + F.lit(i)) if i < 0 else F.least(F.lit(i), n)
    s, e = at(start), n if end is None else at(end)
    return F.slice(a, s + 1, F.greatest(F.lit(0), e - s))


def permutations(fixed: int, mask: int) -> Column:
    """`fixed` combined with every choice of the bits that are set in mask, in counting order."""
    bits = [i for i in range(64) if mask >> i & 1]

    def one(k: Column) -> Column:
        out = F.lit(fixed).cast("long")
        for j, i in enumerate(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(k, j).bitwiseAND(F.lit(1)), i))
        return out

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << len(bits)) - 1).cast("long")), one)


def gaussian(radius: int, sigma: float) -> Column:
    """Weights of a bell of 2 * radius + 1 places, summing to 1."""
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return F.array(*[F.lit(x / sum(w)) for x in w])


def sine_wave(n: int, period: float, height: float = 1.0, phase: float = 0.0) -> Column:
    """n samples of a sine."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(height)) * F.sin(F.lit(2 * math.pi) * i / F.lit(float(period)) + F.lit(float(phase))))


def channel(a: Column, k: int, n: int) -> Column:
    """Every n-th element from the k-th: one channel of interleaved samples."""
    return F.filter(a, lambda _, i: F.pmod(i, F.lit(n)) == k)


def convolve(a: Column, weights: Column) -> Column:
    """Weighted sums around each element; beyond an end its value goes on."""
    n, half = F.size(a), F.floor(F.size(weights) / 2).cast("int")
    at = lambda i: F.get(a, F.least(F.greatest(i, F.lit(0)), n - 1))
    return F.transform(a, lambda _, i: F.aggregate(F.transform(weights, lambda w, k: w * at(i + k - half)), F.lit(0.0), lambda s, x: s + x))


def moving_mean(a: Column, width: int) -> Column:
    """Mean of the elements up to width // 2 before and (width - 1) // 2 behind, as far as there are any."""
    n = F.size(a)

    def one(_: Column, i: Column) -> Column:
        lo, hi = F.greatest(i - width // 2, F.lit(0)), F.least(i + (width - 1) // 2, n - 1)
        return F.aggregate(F.slice(a, lo + 1, hi - lo + 1), F.lit(0.0), lambda s, x: s + x) / (hi - lo + 1)

    return F.transform(a, one)


def soft_max(a: Column, beta: float = 1.0, log: bool = False) -> Column:
    """exp(beta x) of each element over their sum, or the logarithm of that."""
    b = F.lit(float(beta))
    total = F.aggregate(F.transform(a, lambda x: F.exp(b * (x - F.array_max(a)))), F.lit(0.0), lambda s, x: s + x)
    shifted = lambda x: b * (x - F.array_max(a))
    return F.transform(a, lambda x: shifted(x) - F.log(total)) if log else F.transform(a, lambda x: F.exp(shifted(x)) / total)


def resample(a: Column, n: int) -> Column:
    """n values at even distances, between the elements by straight lines."""
    step = (F.size(a) - 1) / F.lit(float(max(1, n - 1)))

    def one(i: Column) -> Column:
        x = i * step
        k = F.least(F.floor(x).cast("int"), F.size(a) - 1)
        low, high = F.get(a, k), F.get(a, F.least(k + 1, F.size(a) - 1))
        return low + (high - low) * (x - k)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def map_get(m: Column, key: Column, default=None) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def reduce_array(a: Column, init: Column, step) -> Column:
    return F.aggregate(a, init, step)
