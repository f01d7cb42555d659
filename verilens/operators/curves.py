"""Error curves and the metrics read off them.

Trials are first collapsed to a (group, score) histogram; cumulative counts
come from the bucketed scan, so no task sees a whole group. Every metric is
then a conditional min/max/sum over curve rows: an aggregate with map-side
combine, with no ordering step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.operators.scan import running, value_bucket

NEG_INF = float("-inf")


def histogram(trials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, t, n_gen, n_imp); vetoed trials keep the score -Infinity."""
    # A NULL score falls into a cell of zero counts: filtering it here would be pushed
    # into the scoring join and compute every score twice.
    known = F.col("score").isNotNull()
    return trials.groupBy(*groups, F.col("score").alias("t")).agg(
        F.count_if(F.col("is_genuine") & known).alias("n_gen"), F.count_if(~F.col("is_genuine") & known).alias("n_imp")
    )


def curve(trials: DataFrame, groups: Sequence[str], anchor: bool = True) -> DataFrame:
    """FAR and FRR at every distinct finite score, plus one threshold below the lowest.

    Accept when score >= t. -Infinity is rejected at every threshold.
    """
    hist = histogram(trials, groups).withColumn("_b", F.coalesce(value_bucket(F.col("t")), F.lit(0)))
    finite = F.col("t") > NEG_INF
    cum = running(
        hist, groups, "_b", ["t"],
        {"cum_gen": ("sum", F.col("n_gen")), "cum_imp": ("sum", F.col("n_imp"))},
        {"g": ("sum", F.col("n_gen")), "i": ("sum", F.col("n_imp")), "lowest": ("min", F.when(finite, F.col("t")))},
    )
    zero = F.lit(0).cast("long")
    below_gen, below_imp = F.col("cum_gen") - F.col("n_gen"), F.col("cum_imp") - F.col("n_imp")

    def point(t, n_gen, n_imp, observed):
        return F.struct(t.alias("t"), n_gen.alias("n_gen"), n_imp.alias("n_imp"), F.lit(observed).alias("observed"))

    here = point(F.col("t"), F.col("n_gen"), F.col("n_imp"), True)
    rows = F.array(here)
    if anchor:
        # The row of the lowest finite score also yields the anchor: all that lies below it is a veto.
        rows = F.when(F.col("t") == F.col("lowest"), F.array(here, point(F.col("t") - 1, zero, zero, False))).otherwise(rows)
    out = cum.filter(finite & (F.col("g") > 0) & (F.col("i") > 0)).select(
        *groups, "g", "i", below_gen.alias("below_gen"), below_imp.alias("below_imp"), F.inline(rows)
    )
    return out.withColumn("far", (F.col("i") - F.col("below_imp")) / F.col("i")).withColumn(
        "frr", F.col("below_gen") / F.col("g")
    )


def _at(cond, by, pick):
    point = F.struct("t", "far", "frr")
    return pick(F.when(cond, point), F.when(cond, by))


def curve_metrics(points: DataFrame, groups: Sequence[str], p_target: float = 0.05, far_targets: dict | None = None) -> DataFrame:
    """One row per group: EER (interpolated and nearest), minDCF, rates at 1%, AUC, order-statistic thresholds.

    The difference FAR - FRR never increases with the threshold, so the first
    sign change is found from three conditional extremes instead of a lead.
    """
    d = F.col("far") - F.col("frr")
    cost = (p_target * F.col("frr") + (1 - p_target) * F.col("far")) / min(p_target, 1 - p_target)
    obs = F.col("observed")
    aggs = [
        F.max("g").alias("n_gen"), F.max("i").alias("n_imp"),
        _at(d > 0, F.col("t"), F.max_by).alias("_up"), _at(d <= 0, F.col("t"), F.min_by).alias("_down"),
        _at(d == 0, F.col("t"), F.max_by).alias("_zero"), F.min(F.when(d < 0, F.lit(1))).alias("_neg"),
        F.min(F.struct(F.abs(d).alias("gap"), "t", "far", "frr")).alias("_near"),
        F.min(F.when(obs, F.struct(F.abs(d).alias("gap"), "t", "far", "frr"))).alias("_fast"),
        F.min(F.struct(cost.alias("cost"), "t")).alias("_dcf"),
        F.min(F.when(F.col("frr") <= 0.01, F.col("far"))).alias("far_at_frr_1pct"),
        F.min(F.when(F.col("far") <= 0.01, F.col("frr"))).alias("frr_at_far_1pct"),
        # Vetoed genuine trials sit below every finite score and tie with vetoed impostors.
        F.sum(F.col("n_gen") * (F.col("below_imp") + F.col("n_imp") / 2)).alias("_u"),
        F.min("below_gen").alias("veto_gen"), F.min("below_imp").alias("veto_imp"),
        F.min(F.when(obs & (F.col("n_gen") > 0), F.col("t"))).alias("gen_min"),
        F.max(F.when(obs & (F.col("n_imp") > 0), F.col("t"))).alias("imp_max"),
        F.count(F.lit(1)).alias("n_points"),
    ]
    for name, target in (far_targets or {}).items():
        k = F.least(F.floor(F.lit(target) * (F.col("i") - 0)), F.col("i") - 1)
        aggs.append(F.max(F.when(obs & (F.col("i") - F.col("below_imp") >= k + 1), F.col("t"))).alias(name))
    m = points.groupBy(*groups).agg(*aggs)
    up, down, zero, near = F.col("_up"), F.col("_down"), F.col("_zero"), F.col("_near")
    d0, d1 = up["far"] - up["frr"], down["far"] - down["frr"]
    a = -d0 / (d1 - d0)
    cross = up.isNotNull() & down.isNotNull()
    touch = up.isNull() & zero.isNotNull() & F.col("_neg").isNotNull()
    eer = (
        F.when(cross, F.greatest(F.lit(0.0), F.least(F.lit(1.0), up["far"] + a * (down["far"] - up["far"]))))
        .when(touch, zero["far"]).otherwise((near["far"] + near["frr"]) / 2)
    )
    thr = F.when(cross, up["t"] + a * (down["t"] - up["t"])).when(touch, zero["t"]).otherwise(near["t"])
    fast = F.col("_fast")
    return m.select(
        *groups, "n_gen", "n_imp", "veto_gen", "veto_imp", eer.alias("eer"), thr.alias("eer_t"),
        ((fast["far"] + fast["frr"]) / 2).alias("eer_nearest"), fast["t"].alias("eer_nearest_t"),
        F.col("_dcf")["cost"].alias("min_dcf"), F.col("_dcf")["t"].alias("min_dcf_t"),
        "far_at_frr_1pct", "frr_at_far_1pct",
        ((F.col("_u") + F.col("veto_gen") * F.col("veto_imp") / 2) / (F.col("n_gen") * F.col("n_imp"))).alias("auc"),
        F.when(F.col("gen_min") > F.col("imp_max"), (F.col("gen_min") + F.col("imp_max")) / 2).otherwise(thr).alias("thr_eer"),
        "gen_min", "imp_max", "n_points", *(far_targets or {}),
    )


def d_prime(trials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean gap over the root mean of sample variances; 0 when degenerate."""
    fin = trials.filter(F.col("score") > NEG_INF)
    g, i = F.when(F.col("is_genuine"), F.col("score")), F.when(~F.col("is_genuine"), F.col("score"))
    m = fin.groupBy(*groups).agg(
        F.avg(g).alias("mg"), F.avg(i).alias("mi"), F.var_samp(g).alias("vg"), F.var_samp(i).alias("vi"),
        F.count(g).alias("ng"), F.count(i).alias("ni"),
    )
    pooled = F.sqrt((F.col("vg") + F.col("vi")) / 2)
    return m.select(
        *groups, "mg", "mi", "ng", "ni",
        F.when((F.col("ng") > 1) & (F.col("ni") > 1) & (pooled > 1e-12), (F.col("mg") - F.col("mi")) / pooled)
        .otherwise(F.lit(0.0)).alias("d_prime"),
    )


def metrics(trials: DataFrame, groups: Sequence[str], **kw) -> DataFrame:
    return curve_metrics(curve(trials, groups), groups, **kw)
