"""Array-of-double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verilens.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def usable_norm(n: Column) -> Column:
    return (n >= F.lit(1e-9)) & ~F.isnan(n) & (n < F.lit(float("inf")))


def unit(v: Column) -> Column:
    """L2-normalised vector; NULL where the norm is zero or not finite."""
    return let(norm(v), lambda n: F.when(usable_norm(n), F.transform(v, lambda x: x / n)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
