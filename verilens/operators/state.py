"""Keyed state over time, in batch form. The streaming forms in ``verilens.streaming`` agree with these."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilens.functions.times import micros


@dataclass(frozen=True)
class Throttle:
    """Free failures, then doubling delays up to a maximum; failures are forgotten after ``forget`` seconds."""

    free: int = 3
    base: float = 5.0
    maximum: float = 30.0
    forget: int = 300

    def delay(self, n):
        over = n - self.free
        return F.when(over > 0, F.least(F.lit(float(self.maximum)), self.base * F.pow(F.lit(2.0), over - 1))).otherwise(F.lit(0.0))


def throttle_waits(attempts: DataFrame, p: Throttle) -> DataFrame:
    """For each attempt (identity, id, ts, failed): live failures before it and the seconds it must still wait.

    Only the last ``forget`` seconds matter, so a series is cut into blocks of that
    length, each seen with the block before it. A hot identity is split over time.
    """
    span = p.forget * 1_000_000
    us = micros("ts")
    home = F.floor(us / span)
    a = attempts.withColumn("us", us).select("*", F.inline(F.array(
        F.struct(home.alias("blk"), F.lit(True).alias("own")), F.struct((home + 1).alias("blk"), F.lit(False).alias("own")))))
    block = Window.partitionBy("identity", "blk").orderBy("us")
    a = a.withColumn("era", F.coalesce(F.sum(F.when(~F.col("failed"), 1)).over(block.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    recent = Window.partitionBy("identity", "blk", "era").orderBy("us").rangeBetween(-(span - 1), -1)
    a = a.withColumn("n_live", F.count(F.when(F.col("failed"), 1)).over(recent)).withColumn("last", F.max(F.when(F.col("failed"), F.col("us"))).over(recent))
    wait = F.greatest(F.lit(0.0), (F.col("last") - F.col("us")) / 1e6 + p.delay(F.col("n_live")))
    return a.filter("own").select("identity", "id", "ts", "failed", "n_live", F.when(p.delay(F.col("n_live")) > 0, wait).otherwise(F.lit(0.0)).alias("wait"))


def consume_challenges(issued: DataFrame, answers: DataFrame, ttl: int) -> DataFrame:
    """Each challenge (identity, challenge, issued) with its first answer inside the TTL; an answer serves one challenge.

    The interval join is an equi-join on (identity, time slot): a challenge looks at
    its own slot and the next, so a hot identity is split by time.
    """
    slot = lambda c: F.floor(micros(c) / (ttl * 1_000_000))
    i = issued.withColumn("_s", F.explode(F.array(slot("issued"), slot("issued") + 1)))
    a = answers.withColumn("_s", slot("answered"))
    gap = micros("answered") - micros("issued")
    m = i.join(a, ["identity", "_s"]).filter((gap > 0) & (gap <= ttl * 1_000_000))
    # The latest open challenge takes the answer; each challenge keeps its first.
    by_answer = m.groupBy("identity", "answer", "answered").agg(F.max(F.struct("issued", "challenge")).alias("c"))
    first = by_answer.groupBy("identity", F.col("c.challenge").alias("challenge")).agg(F.min(F.struct("answered", "answer")).alias("a"), F.count("*").alias("n"))
    out = issued.join(first, ["identity", "challenge"], "left")
    return out.select(
        "identity", "challenge", "issued", F.when(F.col("a").isNull(), "expired").otherwise("consumed").alias("status"),
        F.col("a.answer").alias("answer"), ((micros("a.answered") - micros("issued")) / 1e6).alias("latency"),
        F.coalesce(F.col("n") - 1, F.lit(0)).alias("replays"))
