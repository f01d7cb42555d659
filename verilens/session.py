"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from verilens.sources.held import let_go


def build(app: str = "verilens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster. ``fallback`` serves tests, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: streams need a folder every executor can reach")
    return root


def release(spark: SparkSession) -> None:
    """Drop the persisted intermediates of finished queries."""
    let_go(spark)
