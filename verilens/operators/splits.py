"""Leak-free splits and seeded samples. Shuffles are orderings by a seeded digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.functions.stats import hashed
from verilens.operators.scan import rank_by_digest
from verilens.sources.tables import small_side


def dev_speakers(names: DataFrame, share: float = 0.4, seed: int = 0) -> DataFrame:
    """(k, dev): the seeded first ``share`` of speakers ``k``, at least 2 and leaving at least 2; empty under 4 speakers."""
    ranked = rank_by_digest(names.withColumn("_h", hashed(seed, F.col("k"))), [], "_h", ["k"], "rn", "n")
    n_dev = F.least(F.greatest(F.lit(2), F.bround(F.col("n") * share, 0)), F.col("n") - 2)
    return ranked.filter("n >= 4").select("k", (F.col("rn") <= n_dev).alias("dev"))


def trial_parts(
    trials: DataFrame, a: str = "probe_speaker", b: str = "claimed", share: float = 0.4, seed: int = 0,
    speakers: DataFrame | None = None,
) -> DataFrame:
    """Mark each trial dev or test when both its speakers are on that side, else cohort.

    ``speakers`` (column k) saves reading the trials for their names.
    """
    names = trials.select(F.explode(F.array(a, b)).alias("k")).distinct() if speakers is None else speakers
    d = small_side(dev_speakers(names, share, seed), sized_by=names)
    out = trials.join(d.select(F.col("k").alias(a), F.col("dev").alias("probe_dev")), a).join(
        d.select(F.col("k").alias(b), F.col("dev").alias("_cd")), b
    )
    part = (
        F.when(F.col("probe_dev") & F.col("_cd"), "dev").when(~F.col("probe_dev") & ~F.col("_cd"), "test").otherwise("cohort")
    )
    return out.withColumn("part", part).drop("_cd")


def stratified(units: DataFrame, stratum: str, unit: str, seeds: Sequence[int], share: float = 0.25, min_size: int = 4) -> DataFrame:
    """Seeded norm / fit / test split inside each stratum; small strata go to test. The seed is a column."""
    every = units.select(stratum, unit).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    placed = every.withColumn("_h", F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col(unit).cast("string"))))
    r = rank_by_digest(placed, ["seed", stratum], "_h", [unit], "rn", "n")
    cut = F.greatest(F.lit(1), F.bround(F.col("n") * share, 0))
    part = (
        F.when(F.col("n") < min_size, "test").when(F.col("rn") <= cut, "norm").when(F.col("rn") <= 2 * cut, "fit").otherwise("test")
    )
    return r.select("seed", stratum, unit, part.alias("part"))


def session_sides(units: DataFrame, speaker: str, session: str, order: str, n_probe: int = 1, within: bool = False, fraction: float = 0.3) -> DataFrame:
    """``units`` with side (probe, enrol or dropped) and cross_session: the last ``n_probe`` sessions of a speaker probe.

    Speakers without an earlier session are dropped, or with ``within`` the
    last ``fraction`` of their units probes; what comes of that is marked as
    not across sessions. Sessions are ranked, not units; units are numbered
    in cells of (speaker, session).
    """
    from pyspark.sql import Window

    from verilens.operators.scan import rank_within

    per = units.select(speaker, session).distinct()
    w = Window.partitionBy(speaker)  # a row a session
    per = per.withColumn("_r", F.row_number().over(w.orderBy(F.desc(session)))).withColumn("_k", F.count("*").over(w))
    crossed = F.col("_k") > n_probe
    side = F.when(F.col("_r") <= n_probe, "probe").otherwise("enrol")
    if not within:
        return units.join(per, [speaker, session]).withColumn("side", F.when(crossed, side).otherwise("dropped")).withColumn("cross_session", crossed).drop("_r", "_k")
    placed = rank_within(units.withColumn("_b", F.col(session)), [speaker], "_b", [order], "_i", "_m").drop("_b")
    cut = F.floor(F.col("_m") * (1.0 - fraction))
    own = F.when((cut == 0) | (cut == F.col("_m")), "dropped").when(F.col("_i") <= cut, "enrol").otherwise("probe")
    return placed.join(per, [speaker, session]).withColumn("side", F.when(crossed, side).otherwise(own)).withColumn("cross_session", crossed).drop("_r", "_k", "_i", "_m")


def rank_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per key. The rank filter is applied before the shuffle, so a hot key sends n rows per task."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
