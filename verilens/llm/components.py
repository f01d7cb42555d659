"""Connected components by smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label. A hub with many neighbours is aggregated before
    the shuffle. Rounds end when no label changes.
    """
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct(), "edges")
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = stored(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.filter("old <> comp").isEmpty():
            return labels
