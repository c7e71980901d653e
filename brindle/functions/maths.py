"""Numbers, bits, interpolation, distributions and geography."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / x)


def reciprocal(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def wrap(x: Column, lo: float, hi: float) -> Column:
    """Into [lo, hi) by whole turns."""
    span = F.lit(float(hi - lo))
    return x - span * F.floor((x - F.lit(float(lo))) / span)


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sign_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is below, at or above b."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of longs: enough steps for any pair of 64-bit numbers."""
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.coalesce(F.try_mod(s["x"], s["y"]), F.lit(0).cast("long")).alias("y")))
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(95)), start, step, lambda s: s["x"]))


@F.pandas_udf(T.LongType())
def modular_inverse(a: pd.Series, n: pd.Series) -> pd.Series:
    """x with a * x = 1 modulo n; null if there is none."""

    def one(x, m):
        try:
            return pow(int(x), -1, int(m))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(x, m) for x, m in zip(a, n, strict=True)], dtype="Int64")


def _special(f):
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return f(v)
            except (ValueError, OverflowError):
                return math.nan

        return x.map(one)

    return run


gamma, lgamma, erf, erfc = (_special(f) for f in (math.gamma, math.lgamma, math.erf, math.erfc))


def _digamma(x: float) -> float:
    if x <= 0:
        return math.nan if x == int(x) else _digamma(1 - x) - math.pi / math.tan(math.pi * x)
    r = 0.0
    while x < 10:
        r, x = r - 1 / x, x + 1
    f = 1 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


digamma = _special(_digamma)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def bilerp(a: Column, b: Column, c: Column, d: Column, s: Column, t: Column) -> Column:
    return lerp(lerp(a, b, s), lerp(c, d, s), t)


def hermite(p0: Column, m0: Column, p1: Column, m1: Column, t: Column) -> Column:
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * p0 + (t3 - 2 * t2 + t) * m0 + (3 * t2 - 2 * t3) * p1 + (t3 - t2) * m1


def linear_step(x: Column, a: float, b: float) -> Column:
    return clamp((x - F.lit(float(a))) / F.lit(float(b - a)), 0.0, 1.0)


def smooth_step(x: Column, a: float, b: float) -> Column:
    t = linear_step(x, a, b)
    return t * t * (3 - 2 * t)


def approx_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.lit(float(tolerance))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, within 1e-7, by a rational form of its tail."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution, within 5e-4; null outside (0, 1)."""
    q = F.least(p, F.lit(1.0) - p)
    t = F.sqrt(F.lit(-2.0) * F.log(q))
    z = t - (F.lit(2.515517) + t * (F.lit(0.802853) + t * F.lit(0.010328))) / (F.lit(1.0) + t * (F.lit(1.432788) + t * (F.lit(0.189269) + t * F.lit(0.001308))))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -z).otherwise(z))


def golden_section(f, lo: float, hi: float, tolerance: float = 1e-9) -> float:
    """Place of the minimum of a Python function of one number with one valley."""
    r = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while abs(b - a) > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def bit_test(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x.cast("long"), i).bitwiseAND(F.lit(1)) == 1


def bit_set(x: Column, i: int) -> Column:
    return x.cast("long").bitwiseOR(F.shiftleft(F.lit(1).cast("long"), i))


def bit_clear(x: Column, i: int) -> Column:
    return x.cast("long").bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), i)))


def bit_flip(x: Column, i: int) -> Column:
    return x.cast("long").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i))


def low_mask(n: int) -> Column:
    return F.lit((1 << n) - 1 if n < 64 else -1).cast("long")


def rotate_left(x: Column, n: int, bits: int = 64) -> Column:
    n %= bits
    x = x.cast("long")
    return (F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x.bitwiseAND(low_mask(bits)), bits - n)) if n else x).bitwiseAND(low_mask(bits))


def _spread(x: Column, bits: int, gap: int) -> Column:
    """Every bit of x moved to `gap` times its place."""
    out = F.lit(0).cast("long")
    x = x.cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), i * gap))
    return out


def reverse_bits(x: Column, bits: int = 32) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x.cast("long"), i).bitwiseAND(F.lit(1)), bits - 1 - i))
    return out


def nth_set_bit(x: Column, n: int, bits: int = 64) -> Column:
    """Place of the n-th bit that is set, from 0; null if there are fewer."""
    places = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(x.cast("long"), i) == 1)
    return F.get(places, n)


def morton(*xs: Column, bits: int = 16) -> Column:
    """Interleaved bits of several coordinates: a Z-order key."""
    out = F.lit(0).cast("long")
    for k, x in enumerate(xs):
        out = out.bitwiseOR(F.shiftleft(_spread(x, bits, len(xs)), k))
    return out


def sobol(i: Column, bits: int = 32) -> Column:
    """First coordinate of the Sobol sequence: the bits of the index's Gray code, mirrored."""
    gray = i.cast("long").bitwiseXOR(F.shiftright(i.cast("long"), 1))
    return reverse_bits(gray, bits) / F.lit(float(1 << bits))


#: Semi-major axis and flattening of WGS 84 (fixed values).
_A, _FLAT = 6378137.0, 1 / 298.257223563
_E2 = _FLAT * (2 - _FLAT)


def to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres of degrees and metres above the ellipsoid."""
    f, g = F.radians(lat), F.radians(lon)
    n = F.lit(_A) / F.sqrt(1 - F.lit(_E2) * F.sin(f) * F.sin(f))
    return (n + height) * F.cos(f) * F.cos(g), (n + height) * F.cos(f) * F.sin(g), (n * F.lit(1 - _E2) + height) * F.sin(f)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres of earth-centred coordinates, by a closed first guess and two refinements."""
    b = _A * (1 - _FLAT)
    p = F.sqrt(x * x + y * y)
    ep2 = _E2 / (1 - _E2)

    def step(lat: Column, _: Column) -> Column:
        t = F.atan(F.lit(b / _A) * F.tan(lat))
        return F.atan2(z + F.lit(ep2 * b) * F.pow(F.sin(t), 3), p - F.lit(_E2 * _A) * F.pow(F.cos(t), 3))

    # as a fold, since each step uses the last value several times
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.atan2(z * F.lit(_A * _A), p * F.lit(b * b)), step)
    n = F.lit(_A) / F.sqrt(1 - F.lit(_E2) * F.sin(lat) * F.sin(lat))
    height = F.when(F.abs(F.cos(lat)) > 1e-6, p / F.cos(lat) - n).otherwise(F.abs(z) - F.lit(b))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def datum_shift(x: Column, y: Column, z: Column, move: tuple[float, float, float], turn: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in another datum: moved in metres, turned by small angles in seconds of arc (position vectors), scaled in parts per million."""
    rx, ry, rz = (F.lit(math.radians(a / 3600)) for a in turn)
    s = F.lit(1 + scale * 1e-6)
    return F.lit(move[0]) + s * (x - rz * y + ry * z), F.lit(move[1]) + s * (rz * x + y - rx * z), F.lit(move[2]) + s * (rx * y - ry * x + z)


def from_utm(zone: Column, east: Column, north: Column, south: Column) -> tuple[Column, Column]:
    """Degrees of a UTM place, on the southern half of the earth if south holds: Krueger's series to the fourth order, read backwards."""
    n = _FLAT / (2 - _FLAT)
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi = (north - F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))) / F.lit(0.9996 * a)
    eta = (east - F.lit(500000.0)) / F.lit(0.9996 * a)
    x, y = xi, eta
    for k, c in enumerate(beta, 1):
        x = x - F.lit(c) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - F.lit(c) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, c in enumerate(delta, 1):
        lat = lat + F.lit(c) * F.sin(2 * k * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Zone, easting and northing of degrees, by Krueger's series to the fourth order."""
    n = _FLAT / (2 - _FLAT)
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    zone = (F.floor((lon + 180) / 6) % 60 + 1).cast("int")
    f, g = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = math.sqrt(_E2)
    t = F.sinh(F.atanh(F.sin(f)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(f)))
    xi, eta = F.atan2(t, F.cos(g)), F.atanh(F.sin(g) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, c in enumerate(alpha, 1):
        east = east + F.lit(c) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + F.lit(c) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return zone, F.lit(500000.0) + F.lit(0.9996 * a) * east, F.when(lat < 0, F.lit(1e7)).otherwise(F.lit(0.0)) + F.lit(0.9996 * a) * north
