"""Ordered running aggregates and exact quantiles that never put a whole group in one task.

A window over (key, order) sends all rows of a key to one task, so one key with
a third of the rows stops scaling. Here a monotone *bucket* of the order column
joins the partitioning: each (key, bucket) cell is scanned on its own, and the
carry into a cell is a prefix over the small table of cell totals. Buckets are
plain functions of the value (no sampling), so a recomputed task sees the same
cells and no second pass is needed to choose them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilens.functions.times import micros
from verilens.sources.held import hold

# Cells per factor of two in magnitude: neighbours in one cell differ by under 0.07%.
RESOLUTION = 1024
_FLOOR = 2.0**-40


def value_bucket(x: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone integer bucket of a double on a signed log scale; 0 for values near zero."""
    mag = F.floor(F.log2(F.greatest(F.abs(x), F.lit(_FLOOR))) * resolution) + 41 * resolution
    far = F.lit(-(2**40)).cast("long")  # minus infinity sorts below every finite value
    return (F.when(x == float("-inf"), far).when(F.abs(x) < _FLOOR, F.lit(0)).when(x > 0, mag).otherwise(-mag)).cast("long")


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def hash_bucket(hex_digest: Column, digits: int = 2) -> Column:
    """Leading hex digits: ordering by digest is ordering by (bucket, digest)."""
    return F.substring(hex_digest, 1, digits)


_COMBINE = {
    "sum": (F.sum, lambda carry, here: F.coalesce(carry, F.lit(0)) + here),
    "max": (F.max, lambda carry, here: F.greatest(carry, here)),
    "min": (F.min, lambda carry, here: F.least(carry, here)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    outputs: Mapping[str, tuple[str, Column]],
    overall: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add inclusive running aggregates (``sum``, ``max`` or ``min``) along ``order`` inside ``keys``.

    ``bucket`` must be a column of ``df`` that never decreases along ``order``;
    keys and bucket must not be NULL. ``overall`` adds whole-key aggregates,
    taken from the cell totals so that no second join is needed.

    The placed rows feed both the scan and the totals. They are persisted
    (memory, then disk) because filters and column pruning pushed into the two
    branches would otherwise make them differ and run the input twice.
    """
    overall = overall or {}
    cell = [*keys, bucket]
    placed = df.repartition(*[F.col(c) for c in cell]).transform(hold)
    here = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = placed.select("*", *[_COMBINE[how][0](c).over(here).alias(n) for n, (how, c) in outputs.items()])
    totals = placed.groupBy(*cell).agg(
        *[_COMBINE[how][0](c).alias(f"_t_{n}") for n, (how, c) in {**outputs, **overall}.items()]
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carries = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in cell],
        *[_COMBINE[how][0](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (how, _) in outputs.items()],
        *[_COMBINE[how][0](f"_t_{n}").over(whole).alias(n) for n, (how, _) in overall.items()],
    )
    on = [F.col(c) == F.col(f"_k_{c}") for c in cell]
    joined = scanned.join(carries, on)
    return joined.select(
        *df.columns,
        *[_COMBINE[how][1](F.col(f"_c_{n}"), F.col(n)).alias(n) for n, (how, _) in outputs.items()],
        *overall,
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], name: str = "rn",
    size: str | None = None,
) -> DataFrame:
    """``row_number`` (and group size) inside ``keys`` without one task per key."""
    one = ("sum", F.lit(1).cast("long"))
    return running(df, keys, bucket, order, {name: one}, {size: one} if size else None)


def rank_by_digest(
    df: DataFrame, keys: Sequence[str], digest: str, tie: Sequence[str], name: str = "rn", size: str | None = None
) -> DataFrame:
    """Rank inside ``keys`` by a hex digest column (a seeded shuffle)."""
    placed = df.withColumn("_b", hash_bucket(F.col(digest)))
    return rank_within(placed, keys, "_b", [F.col(digest), *tie], name, size).drop("_b")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float | Column], weight: Column | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key from a value histogram.

    ``percentile`` keeps every distinct value of a group in one buffer; here
    equal values are combined first, cumulative counts come from ``running``
    and each quantile is two conditional minima. A quantile may be a Column
    over the key columns and ``_n`` (the group's row count). ``weight`` says how
    many equal rows a row stands for.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_w"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    both = running(hist, keys, "_b", ["_v"], {"_cum": ("sum", F.col("_w"))}, {"_n": ("sum", F.col("_w"))})
    aggs = []
    for name, q in quantiles.items():
        pos = (F.lit(q) if not isinstance(q, Column) else q) * (F.col("_n") - 1)
        lo = F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_v")))
        hi = F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_v")))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    out = both.groupBy(*keys).agg(*aggs) if keys else both.agg(*aggs)
    return out
