"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written
and read again before the next one. All but the last keep the columns of
``documents``, whatever further ones it has and however they are named.

Defined cases are those of the operators: a null or empty text is clean, has
no lines and no passages; empty texts are one group of copies, of which one
stays; rows that repeat are copies of each other; null ids are ids like
others; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verilens.llm import decontaminate, lines, order_minhash, packing, toxicity
from verilens.llm.common import shared_dir
from verilens.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go. The fit reads the labelled ones among ``docs``."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts; every document stays."""
    return lines.without_boilerplate(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return order_minhash.keep_one(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences."""
    return packing.pack(docs, packing.vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", keep_one), ("decontamination", decontaminated), ("packing", packed)]

#: SQL can express neither the fitted model nor the classes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one gives is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
