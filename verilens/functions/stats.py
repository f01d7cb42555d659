"""Scalar statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n; (0, 1) when n is 0."""
    p = k / n
    z2 = z * z
    den = 1 + z2 / n
    mid = (p + z2 / (2 * n)) / den
    half = (z / den) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    lo = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), mid - half))
    hi = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mid + half))
    return lo, hi


def squash(x: Column, scale: float = 2.0) -> Column:
    return 1 / (1 + F.exp(-x / scale))


def ramp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def jsd2(pa: Column, qa: Column) -> Column:
    """Jensen-Shannon divergence (bits) of two Bernoulli distributions given P(first)."""
    total = None
    p1, q1 = F.greatest(pa, F.lit(EPS)), F.greatest(qa, F.lit(EPS))
    p2, q2 = F.greatest(1 - pa, F.lit(EPS)), F.greatest(1 - qa, F.lit(EPS))
    sp, sq = p1 + p2, q1 + q2
    for p, q in ((p1 / sp, q1 / sq), (p2 / sp, q2 / sq)):
        m = (p + q) / 2
        term = p * F.log2(p / m) + q * F.log2(q / m)
        total = term if total is None else total + term
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 2))


def safe_div(a: Column, b: Column, empty: Column | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(None) if empty is None else empty)


def hashed(seed: object, *cols: Column) -> Column:
    """Seeded hex digest used instead of a random generator: the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform(seed: object, *cols: Column) -> Column:
    """Uniform number in (0, 1) taken from the first 32 bits of the seeded digest."""
    return (F.conv(F.substring(hashed(seed, *cols), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
