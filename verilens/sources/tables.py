"""Reading the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than cores.

    A table stored as one small row group scans as one task, and heavy
    expressions over it would run on one core. With enough splits (any large
    table) this changes nothing and adds no shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys])


def bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = 200_000, sized_by: DataFrame | None = None) -> DataFrame:
    """Broadcast hint behind a row-count check; otherwise the join shuffles and AQE splits hot keys.

    ``sized_by`` has as many rows as ``df`` (or a fixed share of them) and is
    cheap to count; without it ``df`` itself is counted.
    """
    return F.broadcast(df) if bounded(df if sized_by is None else sized_by, max_rows) else df
