"""All-pairs joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.sources.tables import bounded


def each_with_each(
    many: DataFrame, few: DataFrame, sized_by: DataFrame, few_key: list[str], many_key: list[str], max_rows: int = 20_000
) -> DataFrame:
    """Every row of ``many`` with every row of ``few`` (probes against enrolled models).

    The pair table is the defined output of a verification trial list. With at
    most ``max_rows`` models (``sized_by`` has the same row count and is cheap
    to count) the models are broadcast and the probes never move. Beyond that
    both sides are laid on a grid: an equi-join on (row block, column block),
    each side repeated once per block of the other, so every task holds one tile.
    """
    if bounded(sized_by, max_rows):
        return many.join(F.broadcast(few))
    n_few = sized_by.count()
    columns = -(-n_few // max_rows)
    rows = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = many.withColumn("_r", F.pmod(F.xxhash64(*many_key), F.lit(rows))).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    right = few.withColumn("_c", F.pmod(F.xxhash64(*few_key), F.lit(columns)).cast("int")).withColumn(
        "_r", F.explode(F.expr(f"sequence(0L, {rows - 1}L)"))
    )
    return left.join(right, ["_r", "_c"]).drop("_r", "_c")
