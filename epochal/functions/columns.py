"""Column functions: geography, names, skew, load schedules, random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Syllables of generated last names, by digit (fixed values).
SYLLABLES = ["BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING"]


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def last_name(number) -> Column:
    """Three syllables from the digits of 0..999."""
    s = F.array(*map(F.lit, SYLLABLES))
    digit = lambda ten: F.element_at(s, (F.floor(number / ten) % 10 + 1).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def uniform(seed: int, *cols) -> Column:
    """Deterministic number in [0, 1): 52 bits of the digest of seed and columns, as other engines can compute it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def derived_uuid(*cols) -> Column:
    """An id in the usual form that is the same for the same request on every run."""
    h = F.md5(F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def non_uniform(a: int, x: int, y: int, c: int, seed: int, *cols) -> Column:
    """Skewed integer in [x, y]: bitwise or of two uniform draws, shifted by ``c``."""
    r1 = F.floor(uniform(seed, *cols) * (a + 1)).cast("long")
    r2 = F.floor(uniform(seed + 1, *cols) * (y - x + 1)).cast("long") + x
    return F.pmod(r1.bitwiseOR(r2) + c, F.lit(y - x + 1)) + x


def zipf_constants(n: int, theta: float) -> tuple[float, float, float]:
    zeta = sum(1 / i**theta for i in range(1, n + 1))
    zeta2 = 1 + 0.5**theta
    return zeta, 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - zeta2 / zeta)


def zipf(u, n: int, theta: float) -> Column:
    """Rank 0..n-1 of a Zipf distribution from a uniform number, by the usual closed approximation."""
    zeta, alpha, eta = zipf_constants(n, theta)
    uz = u * zeta
    deep = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - eta + 1, F.lit(alpha))).cast("long")
    return F.when(uz < 1, F.lit(0).cast("long")).when(uz < 1 + 0.5**theta, F.lit(1).cast("long")).otherwise(F.least(deep, F.lit(n - 1)))


def cosine_load(t, mean: float, amplitude: float, period: float) -> Column:
    return F.lit(mean) + F.lit(amplitude) * F.cos(F.lit(2 * math.pi) * t / F.lit(period))


def step_load(t, start: float, step: float, every: float) -> Column:
    return F.lit(start) + F.lit(step) * F.floor(t / F.lit(every))


def linear_load(t, start: float, end: float, duration: float) -> Column:
    """Increasing or decreasing between two rates."""
    return F.lit(start) + F.lit(end - start) * F.least(t / F.lit(duration), F.lit(1.0))


def random_load(t, low: float, high: float, seed: int) -> Column:
    return F.lit(low) + F.lit(high - low) * uniform(seed, F.floor(t))
