"""Persisted intermediates of the query being built.

Several operators read one intermediate twice (rows and their totals, say).
Such tables are persisted to memory and disk; a lost executor recomputes its
part from lineage. They are let go when the next query is built, so a long
session does not fill up.

A table that many later steps build on is written to the shared folder and read
again (``settled``): its plan ends there, and no executor holds it alone.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(kept)
    return kept


def let_go(spark: SparkSession) -> None:
    while _HELD:
        df = _HELD.pop()
        if df.sparkSession is spark:  # nothing to do for a session that has ended
            df.unpersist()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="held-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again; a temporary folder serves a session on one machine that names none."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder every executor can reach")
        root = _own_folder()
    path = f"{root}/held/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
