"""A keyed table kept as a log of changes: upserts and removals by batch, read by latest version.

A batch is one folder of the log, named by its id and written in overwrite
mode, so that a batch that is replayed replaces itself and changes nothing. A
change is a row with the key, the values, the order columns and ``removed``
(a tombstone). The state is the last change of each key, without tombstones.
``compact`` writes the state up to a batch by key range; readers take the
newest such base and the batches after it. Nothing is rewritten in place, so a
failed writer leaves the old state readable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verilens.operators.corpus import latest


def state(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last change of each key, keys whose last change is a removal left out; NULL key parts are values like others."""
    return latest(changes, keys, order).filter(~F.coalesce("removed", F.lit(False)))


def append(changes: DataFrame, path: str, batch: int) -> None:
    """Write one batch of changes; writing it again replaces it."""
    changes.write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def sink(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each micro-batch under its id."""
    return lambda df, batch: append(prepare(df), path, batch)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def changes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(changes that make up the state, batch up to which a base holds them; -1 without a base)."""
    base, log = _table(spark, f"{path}/base"), _table(spark, f"{path}/log")
    if log is None:
        raise FileNotFoundError(f"{path} holds no batches")
    upto = -1 if base is None else base.agg(F.max("upto")).first()[0]  # partition values alone
    after = log.filter(F.col("batch") > upto).drop("batch")
    if upto is None or upto < 0:
        return log.drop("batch"), -1
    return base.filter(F.col("upto") == upto).drop("upto").unionByName(after), upto


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The state of the table."""
    return state(changes(spark, path)[0], keys, order).drop("removed")


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column | str]) -> int:
    """Write the state up to the newest batch as a base, dealt and sorted by key; returns that batch.

    Tombstones stay in the base: a change of an older order that arrives late
    must not bring a removed key back.
    """
    newest = spark.read.parquet(f"{path}/log").agg(F.max("batch")).first()[0]
    rows, upto = changes(spark, path)
    if newest > upto:
        last = latest(rows, keys, order)
        last.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/base/upto={newest}")
    return newest
