"""Vector and error-curve queries over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilens.functions.vector import dot
from verilens.operators import curves as C
from verilens.operators import vectors as V
from verilens.plans.registry import query
from verilens.plans.sqlviews import CENT, HOLD, TRIALS, VEC, curve, metrics
from verilens.sources import views

WEIGHT = "list_sum(list_transform({e}, lambda x, i: x * i))"


def weighted(col):
    """Position-weighted sum: a one-number fingerprint of a vector for the SQL check."""
    return F.aggregate(F.transform(col, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def units(spark, sf):
    return V.unit_vectors(views.vectors(spark, sf))


def trials(spark, sf):
    return V.holdout_trials(units(spark, sf)).withColumn("variant", F.lit("baseline"))


@query("unit_vectors", "vec_id:l speaker:l norm:d checksum:d", f"""WITH {VEC}
SELECT vec_id, speaker, sqrt(list_dot_product(v, v)) AS norm, {WEIGHT.format(e='v')} AS checksum FROM uv""")
def unit_vectors(spark, sf):
    u = units(spark, sf)
    return u.select("vec_id", "speaker", F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm"), weighted(F.col("v")).alias("checksum"))


@query("centroids", "speaker:l n:l checksum:d", f"""WITH {CENT}
SELECT claimed AS speaker, n, {WEIGHT.format(e='c')} AS checksum FROM cent JOIN (SELECT speaker AS claimed, count(*) AS n FROM uv GROUP BY ALL) USING (claimed)""")
def centroids(spark, sf):
    c = V.centroids(units(spark, sf), ["speaker"])
    return c.select("speaker", "n", weighted(F.col("c")).alias("checksum"))


@query("self_consistency", "speaker:l n:l consistency:d", f"""WITH {VEC}
SELECT speaker, n, CASE WHEN n < 2 THEN 1 ELSE m END AS consistency FROM
(SELECT a.speaker, count(DISTINCT a.vec_id) AS n, avg(list_dot_product(a.v, b.v)) FILTER (a.vec_id <> b.vec_id) AS m
 FROM uv a JOIN uv b ON a.speaker = b.speaker GROUP BY ALL)""")
def self_consistency(spark, sf):
    return V.self_consistency(units(spark, sf), ["speaker"])


@query("cosine_trials", "vec_id:l probe_speaker:l claimed:l is_genuine:b score:d",
       f"WITH {CENT} SELECT vec_id, probe_speaker, claimed, is_genuine, score FROM ctrials")
def cosine_trials(spark, sf):
    return V.centroid_trials(units(spark, sf))


@query("loso_scores", "vec_id:l probe_speaker:l claimed:l fold:l is_genuine:b score:d",
       f"WITH {TRIALS} SELECT vec_id, probe_speaker, claimed, fold, is_genuine, score FROM trials")
def loso_scores(spark, sf):
    return trials(spark, sf)


@query("eer_by_label", "claimed:l n_gen:l n_imp:l eer:d eer_t:d min_dcf:d auc:d",
       f"WITH {TRIALS}, {curve('trials', 'claimed')}, {metrics('claimed')} SELECT claimed, n_gen, n_imp, eer, eer_t, min_dcf, auc FROM mt")
def eer_by_label(spark, sf):
    return C.metrics(trials(spark, sf), ["claimed"])


_ALL = f"WITH {TRIALS}, tv AS (SELECT *, 'baseline' AS variant FROM trials), {curve('tv', 'variant')}, {metrics('variant')} "


@query("det_curve", "variant threshold:d far:d frr:d far_floor:d frr_floor:d",
       _ALL + "SELECT variant, t AS threshold, far, frr, greatest(far, 0.5 / greatest(g, i)) AS far_floor, greatest(frr, 0.5 / greatest(g, i)) AS frr_floor FROM cv")
def det_curve(spark, sf):
    low = 0.5 / F.greatest("g", "i")
    return C.curve(trials(spark, sf), ["variant"]).select(
        "variant", F.col("t").alias("threshold"), "far", "frr", F.greatest("far", low).alias("far_floor"), F.greatest("frr", low).alias("frr_floor"))


@query("eer", "variant eer:d eer_t:d eer_nearest:d eer_nearest_t:d",
       _ALL + "SELECT variant, eer, eer_t, eer_nearest, eer_nearest_t FROM mt")
def eer(spark, sf):
    return C.metrics(trials(spark, sf), ["variant"])


@query("verification_metrics", "variant n_gen:l n_imp:l eer:d min_dcf:d far_at_frr_1pct:d frr_at_far_1pct:d auc:d gen_min:d imp_max:d",
       _ALL + "SELECT * FROM mt")
def verification_metrics(spark, sf):
    return C.metrics(trials(spark, sf), ["variant"])


@query("d_prime", "claimed:l d_prime:d", f"""WITH {TRIALS} SELECT claimed, CASE WHEN p > 1e-12 THEN (mg - mi) / p ELSE 0 END AS d_prime FROM
(SELECT claimed, avg(score) FILTER (is_genuine) AS mg, avg(score) FILTER (NOT is_genuine) AS mi,
 sqrt((var_samp(score) FILTER (is_genuine) + var_samp(score) FILTER (NOT is_genuine)) / 2) AS p FROM trials GROUP BY ALL)""")
def d_prime(spark, sf):
    return C.d_prime(trials(spark, sf), ["claimed"])
