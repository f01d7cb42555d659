"""Log-likelihood-ratio scoring of probes against behaviour graphs.

A probe enters as class counts (at most 21 rows), so scoring is one equi-join on
class and two weighted sums per (probe, claimed speaker). Tokens are never joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.functions.stats import ramp, squash
from verilens.operators import graph as G
from verilens.sources.tables import small_side
from verilens.sources.held import hold


@dataclass(frozen=True)
class StreamWeights:
    """Shares of the lexical, transition and metrics streams; they add up to 1."""

    lexical: float = 0.6
    transition: float = 0.3
    metrics: float = 0.1

    def __post_init__(self) -> None:
        if abs(self.lexical + self.transition + self.metrics - 1) > 1e-6:
            raise ValueError("stream weights must add up to 1")

    def without(self, stream: str) -> StreamWeights:
        w = {**self.__dict__, stream: 0.0}
        total = sum(w.values())
        return StreamWeights(**{k: v / total for k, v in w.items()})


METRICS_SCALE, METRICS_LOW, METRICS_FULL, MIN_TOKENS = 25.0, 20.0, 60.0, 5


def utterance_cells(choices: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Class counts per utterance: the only table scoring needs, read several times and therefore persisted."""
    of = G.word_cells if "words" in choices.columns else G.cells
    return of(choices, ["utt", "speaker", "session", *extra]).transform(hold)


def cell_mixing(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CMI and I-index straight from class counts: a switch is a transition that changes language."""
    s = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in G.COUNTS])
    n, bounds = F.col("n_a") + F.col("n_b"), sum((F.col(c) for c in G.COUNTS[3:]), F.col("t_aa"))
    return s.select(
        *keys, F.when(n > 0, 100 * (1 - F.greatest("n_a", "n_b") / n)).otherwise(F.lit(0.0)).alias("cmi"),
        F.when(bounds > 0, (F.col("t_ab") + F.col("t_ba")) / bounds).otherwise(F.lit(0.0)).alias("i_index"),
    )


def models(cells: DataFrame, keys: Sequence[str] = ("speaker",)) -> DataFrame:
    """Log ratios of each enrolled speaker against everyone else. Extra keys (a budget, say) come first."""
    pooled = cells.groupBy(*keys, "cls").agg(*[F.sum(c).cast("long").alias(c) for c in G.COUNTS])
    counts = G.dense(pooled, list(keys))
    own = G.smooth(counts, keys)
    rest = G.smooth(G.leave_one_out(counts, keys[-1], keys[:-1]), keys)
    return G.log_ratios(own, rest, keys)


def streams(
    probe_cells: DataFrame, enrol_cells: DataFrame, ratios: DataFrame, extra: Sequence[str] = (), low_signal: bool = False,
) -> DataFrame:
    """Every probe against every model: mean lexical and transition log ratios and metric distances."""
    cell = probe_cells.drop("session").withColumnRenamed("speaker", "probe_speaker")
    model = ratios.withColumnRenamed("speaker", "claimed")
    use = F.lit(True) if low_signal else ~F.col("low")

    def weighted(names):
        total = None
        for n, r in names:
            term = F.col(n) * F.col(r)
            total = term if total is None else total + term
        return F.sum(F.when(use, total).otherwise(F.lit(0.0)))

    def counted(names):
        return F.sum(F.when(use, sum((F.col(n) for n in names[1:]), F.col(names[0]))).otherwise(F.lit(0))).cast("long")

    # 21 rows per model; counting the enrolled keys also fills the persisted cells.
    enrolled = enrol_cells.select(*extra, "speaker").distinct()
    s = cell.join(small_side(model, 10_000, enrolled), "cls").groupBy(*extra, "utt", "probe_speaker", "claimed").agg(
        weighted([("n_a", "l_a"), ("n_b", "l_b")]).alias("_lex"), counted(["n_a", "n_b"]).alias("n_scored"),
        weighted([("t_aa", "l_aa"), ("t_ab", "l_ab"), ("t_ba", "l_ba"), ("t_bb", "l_bb")]).alias("_tr"),
        counted(["t_aa", "t_ab", "t_ba", "t_bb"]).alias("_ntr"),
    )
    pm = cell_mixing(probe_cells, ["utt"]).select("utt", F.col("cmi").alias("_pc"), F.col("i_index").alias("_pi"))
    em = cell_mixing(enrol_cells, [*extra, "speaker"]).select(*extra, F.col("speaker").alias("claimed"), F.col("cmi").alias("_ec"), F.col("i_index").alias("_ei"))
    s = s.join(pm, "utt").join(em, [*extra, "claimed"])
    dist = (F.abs(F.col("_pc") - F.col("_ec")) / 100 + F.abs(F.col("_pi") - F.col("_ei"))) / 2
    conf = ramp(F.col("n_scored"), METRICS_LOW, METRICS_FULL)
    return s.select(
        *extra, "utt", "probe_speaker", "claimed", (F.col("probe_speaker") == F.col("claimed")).alias("is_genuine"), "n_scored",
        F.when(F.col("n_scored") > 0, F.col("_lex") / F.col("n_scored")).otherwise(F.lit(0.0)).alias("lex"),
        F.when(F.col("_ntr") > 0, F.col("_tr") / F.col("_ntr")).otherwise(F.lit(0.0)).alias("trans"),
        F.when(conf > 0, -dist * METRICS_SCALE).otherwise(F.lit(0.0)).alias("met"), conf.alias("confidence"),
    )


def mix_streams(s: DataFrame, w: StreamWeights = StreamWeights(), name: str = "raw") -> DataFrame:
    """Blend the streams: the metrics weight ramps in with evidence, the rest is shared by the other two."""
    wm = w.metrics * F.col("confidence")
    both = w.lexical + w.transition
    return s.withColumn(
        name, (w.lexical / both * F.col("lex") + w.transition / both * F.col("trans")) * (1 - wm) + wm * F.col("met")
    )


def with_score(trials: DataFrame) -> DataFrame:
    """Squashed score; NULL when too few tokens were scored."""
    return trials.withColumn("score", F.when(F.col("n_scored") >= MIN_TOKENS, squash(F.col("raw"), 2.0)))


def cohort_stats(trials: DataFrame, keys: Sequence[str] = ("claimed",)) -> DataFrame:
    """Mean and deviation of impostor raw scores per model; (0, 1) under two scores or without spread."""
    imp = trials.filter(~F.col("is_genuine")).groupBy(*keys).agg(
        F.count("raw").alias("n"), F.avg("raw").alias("_m"), F.stddev_samp("raw").alias("_s")
    )
    return imp.select(
        *keys, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("_m")).alias("mean"),
        F.when((F.col("n") >= 2) & (F.col("_s") > 1e-6), F.col("_s")).otherwise(F.lit(1.0)).alias("std"),
    )


def apply_znorm(trials: DataFrame, stats: DataFrame, keys: Sequence[str] = ("claimed",)) -> DataFrame:
    """Replace the score by the squashed z-score; models without statistics use (0, 1)."""
    z = (F.col("raw") - F.coalesce("mean", F.lit(0.0))) / F.coalesce("std", F.lit(1.0))
    return (
        trials.join(stats.select(*keys, "mean", "std"), list(keys), "left").withColumn("z", z)
        .withColumn("score", F.when(F.col("score").isNotNull(), squash(F.col("z"), 1.5))).drop("mean", "std")
    )
