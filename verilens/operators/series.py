"""Checks over ordered event series.

A key's series is never one task: ranks come from the bucketed scan over time
cells, and neighbour windows run inside blocks of consecutive rows that carry a
short halo of rows from the next block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilens.operators.scan import rank_within, running, time_bucket

DAY = 86_400


def numbered(events: DataFrame, keys: Sequence[str], ts: str, tie: str, cell_seconds: int = DAY) -> DataFrame:
    """Add ``rn`` (1-based position in the key's series) and ``len`` (its length)."""
    placed = events.withColumn("_cell", time_bucket(F.col(ts), cell_seconds))
    return rank_within(placed, keys, "_cell", [ts, tie], "rn", "len").drop("_cell")


def blocks(rows: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy rows into blocks of ``size`` positions with a halo; ``own`` marks the block a row belongs to."""
    i = F.col("rn") - 1
    home = F.floor(i / size)
    to = [F.struct(home.alias("blk"), F.lit(True).alias("own"))]
    if before:  # a row near the end of its block is also seen by the next one
        to.append(F.when(i % size >= size - before, F.struct((home + 1).alias("blk"), F.lit(False).alias("own"))))
    if after:
        to.append(F.when((i % size < after) & (home > 0), F.struct((home - 1).alias("blk"), F.lit(False).alias("own"))))
    return rows.select("*", F.inline(F.array_compact(F.array(*to))))


def true_runs(events: DataFrame, keys: Sequence[str], ts: str, tie: str, cond: Column, min_len: int) -> DataFrame:
    """Maximal runs of ``cond``: a run's rows share the number of failing rows before them, so no lag is needed."""
    placed = events.withColumn("_ok", cond).withColumn("_cell", time_bucket(F.col(ts), DAY))
    one = F.lit(1).cast("long")
    r = running(placed, keys, "_cell", [ts, tie], {"rn": ("sum", one), "_bad": ("sum", F.when(F.col("_ok"), 0).otherwise(1).cast("long"))})
    runs = r.filter("_ok").groupBy(*keys, "_bad").agg(F.min("rn").alias("start"), F.max("rn").alias("_last"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= min_len).select(*keys, (F.col("start") - 1).alias("start"), F.col("_last").alias("end"), "n")


def curvature_spikes(rows: DataFrame, key: str, value: str, block: int = 20, sigma: float = 3.0, ratio: float = 0.5) -> DataFrame:
    """Second differences that stand out in their block, first of each burst. ``rows`` are numbered."""
    w = Window.partitionBy(key, "blk").orderBy("rn")
    x = F.col(value)
    c = blocks(rows, block, before=2).withColumn("curve", F.abs(x - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))).filter("own")
    whole = rows.groupBy(key).agg(F.sqrt(F.avg(x * x)).alias("_g"))
    loc = c.groupBy(key, "blk").agg(F.percentile("curve", 0.5).alias("_m"), F.sqrt(F.avg(x * x)).alias("_r"))  # at most one block of rows
    s = c.join(loc, [key, "blk"]).join(whole, key)
    limit = F.greatest(sigma * F.col("_m"), ratio * F.greatest(F.col("_r"), 0.1 * F.col("_g")))
    spikes = s.filter(F.col("curve") > limit).select(key, "rn", "curve")
    prev = spikes.select(key, (F.col("rn") + 1).alias("rn"))
    return spikes.join(prev, [key, "rn"], "left_anti")


def sliding_rms(rows: DataFrame, key: str, value: str, width: int, step: int) -> DataFrame:
    """RMS of every full window of ``width`` rows that starts on a multiple of ``step``."""
    w = Window.partitionBy(key, "blk").orderBy("rn").rowsBetween(0, width - 1)
    sq = F.col(value) * F.col(value)
    b = blocks(rows, max(width * 4, 64), after=width - 1)
    r = b.withColumn("rms", F.sqrt(F.avg(sq).over(w))).withColumn("_n", F.count("*").over(w))
    return r.filter((F.col("own")) & (F.col("_n") == width) & ((F.col("rn") - 1) % step == 0) & (F.col("rn") - 1 + width < F.col("len"))).select(key, "rn", "rms")


def frames(events: DataFrame, key: str, ts: str, value: str, seconds: int = DAY) -> DataFrame:
    """Mean square per key and time frame; a key has at most one row per frame."""
    x = F.col(value)
    return events.groupBy(key, time_bucket(F.col(ts), seconds).alias("frame")).agg(F.avg(x * x).alias("ms"), F.count("*").alias("n"))


def level_steps(fr: DataFrame, key: str, lo: DataFrame, min_pause: int, context: int, step: float) -> DataFrame:
    """Quiet pauses whose background differs before and after. ``fr`` has idx and le per frame, ``lo`` a quiet cut per key."""
    w = Window.partitionBy(key).orderBy("idx")  # one row per time frame
    q = fr.join(lo, key).withColumn("quiet", F.col("le") <= F.col("cut")).withColumn("_bad", F.sum(F.when(F.col("quiet"), 0).otherwise(1)).over(w))
    runs = q.filter("quiet").groupBy(key, "_bad", "n_frames").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e")).filter(F.col("e") - F.col("s") >= min_pause)
    runs = runs.filter((F.col("s") >= 2) & (F.col("e") <= F.col("n_frames") - 2))
    half = F.greatest(F.lit(1), F.floor((F.col("e") - F.col("s")) / 2))
    side = F.array(
        F.struct(F.lit("left").alias("side"), F.greatest(F.lit(0), F.col("s") - context).alias("a"), (F.col("s") + half).alias("b")),
        F.struct(F.lit("right").alias("side"), (F.col("e") - half).alias("a"), F.least(F.col("n_frames"), F.col("e") + context).alias("b")))
    around = runs.select(key, "s", "e", F.inline(side)).select(key, "s", "e", "side", (F.col("b") - F.col("a")).alias("m"), F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("idx"))
    v = around.join(fr.select(key, "idx", "le"), [key, "idx"])
    r = v.withColumn("r", F.row_number().over(Window.partitionBy(key, "s", "side").orderBy("le", "idx")))
    tone = r.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("m") * 0.3))).groupBy(key, "s", "e").agg(
        F.avg(F.when(F.col("side") == "left", F.col("le"))).alias("l"), F.avg(F.when(F.col("side") == "right", F.col("le"))).alias("r"))
    return tone.withColumn("step", F.abs(F.col("l") - F.col("r"))).filter(F.col("step") >= step)
