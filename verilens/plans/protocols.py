"""Evaluation protocols over `embeddings` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilens.operators import corpus as H
from verilens.operators import curves as C
from verilens.operators import llr as L
from verilens.operators import splits as S
from verilens.operators import vectors as V
from verilens.operators.scan import exact_quantiles, rank_by_digest, rank_within
from verilens.plans import sqlviews as Q
from verilens.plans.registry import query
from verilens.plans.speech import enrol_probe, llr_split, speaker_names
from verilens.plans.vectors import trials, units
from verilens.sources import views
from verilens.sources.tables import small_side
from verilens.sources.held import hold, settled

NORM = (8, 9)
#: A budget that no table can reach: everything.
ALL = 9223372036854775807
_U = Q.unit

VEC_MS = Q.VEC.replace("uv AS (", "uv0 AS (").replace("dims AS", f"""mu AS (SELECT list(x ORDER BY d) AS mu FROM (SELECT d, avg(x) AS x FROM
 (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM uv0 WHERE speaker IN {NORM}) GROUP BY d)),
ms AS (SELECT vec_id, speaker, session, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS m FROM uv0, mu),
uv AS (SELECT vec_id, speaker, session, {_U('m')} AS v FROM ms), dims AS""")
TRIALS_MS = Q.TRIALS.replace(Q.VEC, VEC_MS)
_TEST = f"probe_speaker NOT IN {NORM} AND claimed NOT IN {NORM}"


def base(spark, sf):
    u = units(spark, sf)
    return u.filter(~F.col("speaker").isin(*NORM)), u.filter(F.col("speaker").isin(*NORM))


def meansub(spark, sf):
    u = units(spark, sf)
    m = V.mean_subtracted(u, u.filter(F.col("speaker").isin(*NORM)))
    return m.filter(~F.col("speaker").isin(*NORM)), m.filter(F.col("speaker").isin(*NORM))


_COLS = "vec_id:l probe_speaker:l claimed:l fold:l is_genuine:b score:d"


@query("scores_meansub", _COLS, f"WITH {TRIALS_MS} SELECT * FROM trials WHERE {_TEST}")
def scores_meansub(spark, sf):
    return V.holdout_trials(meansub(spark, sf)[0])


def _asnorm_sql(trials_sql):
    return f"""{trials_sql}, co AS (SELECT vec_id AS cid, v AS cv FROM uv WHERE speaker IN {NORM}), kk AS (SELECT greatest(2, least(100, count(*) // 2)) AS k FROM co),
 pt AS (SELECT vec_id, avg(s) AS mp, stddev_pop(s) + 1e-6 AS sp FROM (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS r FROM (SELECT vec_id, list_dot_product(v, cv) AS s FROM uv CROSS JOIN co)), kk WHERE r <= k GROUP BY ALL),
 tt AS (SELECT claimed, fold, avg(s) AS mt, stddev_pop(s) + 1e-6 AS st FROM (SELECT claimed, fold, s, row_number() OVER (PARTITION BY claimed, fold ORDER BY s DESC) AS r FROM (SELECT claimed, fold, list_dot_product(c, cv) AS s FROM tmpl CROSS JOIN co)), kk WHERE r <= k GROUP BY ALL),
 az AS (SELECT t.* REPLACE (((score - mt) / st + (score - mp) / sp) / 2 AS score) FROM trials t JOIN pt USING (vec_id) JOIN tt USING (claimed, fold) WHERE {_TEST})"""


def asnorm(pair):
    test, norm_units = (p.transform(settled) for p in pair)  # each is read by several steps
    n = norm_units.count()
    k = max(2, min(100, n // 2))
    return V.adaptive_norm(V.holdout_trials(test), V.holdout_templates(test), test, norm_units, k)


@query("scores_asnorm", _COLS, f"WITH {_asnorm_sql(Q.TRIALS)} SELECT * FROM az")
def scores_asnorm(spark, sf):
    return asnorm(base(spark, sf))


@query("scores_meansub_asnorm", _COLS, f"WITH {_asnorm_sql(TRIALS_MS)} SELECT * FROM az")
def scores_meansub_asnorm(spark, sf):
    return asnorm(meansub(spark, sf))


_TRIM = Q.TRIALS + f""", ow AS (SELECT claimed, fold, v, list_dot_product(v, c) AS own FROM uv JOIN tmpl ON speaker = claimed AND session <> fold),
 ct AS (SELECT claimed, fold, quantile_cont(own, 0.2) AS cut FROM ow GROUP BY ALL),
 kd AS (SELECT claimed, fold, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM ow JOIN ct USING (claimed, fold) WHERE own >= cut - 1e-12),
 t2 AS (SELECT claimed, fold, {_U('c')} AS c FROM (SELECT claimed, fold, list(x ORDER BY d) AS c FROM (SELECT claimed, fold, d, avg(x) AS x FROM kd GROUP BY ALL) GROUP BY ALL)),
 tr2 AS (SELECT vec_id, speaker AS probe_speaker, session, claimed, fold, speaker = claimed AS is_genuine, list_dot_product(v, c) AS score FROM uv JOIN t2 ON speaker <> claimed OR session = fold)"""


@query("scores_trimmed", _COLS, f"WITH {_TRIM} SELECT * FROM tr2 WHERE {_TEST}")
def scores_trimmed(spark, sf):
    test, _ = base(spark, sf)
    return V.trials_against(test, V.trimmed_templates(test), test.select("speaker", "session").distinct())


@query("seed_sweep", "lowest:d median:d highest:d n:l", f"""WITH {Q.TRIALS}, sd AS (SELECT s FROM range(1, 8) r(s)), k0 AS (SELECT DISTINCT speaker AS k FROM uv),
 pk AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || k), k) AS r, count(*) OVER (PARTITION BY s) AS n FROM sd CROSS JOIN k0),
 st AS (SELECT a.s AS seed, t.* FROM trials t JOIN pk a ON a.k = probe_speaker AND a.r > round_even(a.n * 0.5::DOUBLE, 0) JOIN pk b ON b.k = claimed AND b.s = a.s AND b.r > round_even(b.n * 0.5::DOUBLE, 0)),
 {Q.curve('st', 'seed')}, {Q.metrics('seed')} SELECT min(eer) AS lowest, quantile_cont(eer, 0.5) AS median, max(eer) AS highest, count(*) AS n FROM mt""")
def seed_sweep(spark, sf):
    """The population split repeated over seeds; the seed is a group column."""
    u = units(spark, sf)
    k = u.select(F.col("speaker").alias("k")).distinct().select("k", F.explode(F.expr("sequence(1, 7)")).alias("seed"))
    k = k.withColumn("_h", F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("k").cast("string"))))
    test = small_side(rank_by_digest(k, ["seed"], "_h", ["k"], "rn", "n").filter(F.col("rn") > F.bround(F.col("n") * 0.5, 0)).select("seed", "k"), sized_by=k)
    t = V.holdout_trials(u).join(test.withColumnRenamed("k", "probe_speaker"), "probe_speaker").join(test.withColumnRenamed("k", "claimed"), ["seed", "claimed"])
    m = C.metrics(t, ["seed"]).select("eer").transform(hold)
    q = exact_quantiles(m, [], "eer", {"lowest": 0.0, "median": 0.5, "highest": 1.0})
    return q.join(F.broadcast(m.agg(F.count("*").alias("n"))))  # one row


@query("length_artefact", "kind n_gen:l n_imp:l eer:d auc:d", f"""WITH {Q.TRIALS}, lt AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 'whole' ELSE 'probe' END AS k, * FROM trials),
 la AS (SELECT 'matched_' || k AS kind, is_genuine, score FROM lt UNION ALL SELECT 'mismatched', is_genuine, score FROM lt WHERE is_genuine = (k = 'whole')), {Q.curve('la', 'kind')}, {Q.metrics('kind')} SELECT kind, n_gen, n_imp, eer_nearest AS eer, auc FROM mt""")
def length_artefact(spark, sf):
    """Matched and mismatched probe lengths as three tagged score sets."""
    whole = F.col("vec_id") % 4 == 0
    tags = F.array_compact(F.array(F.when(whole, "matched_whole").otherwise("matched_probe"), F.when(F.col("is_genuine") == whole, "mismatched")))
    return C.metrics(trials(spark, sf).withColumn("kind", F.explode(tags)), ["kind"]).withColumn("eer", F.col("eer_nearest"))


@query("budget_curve", "budget:l eer:d genuine_mean:d", f"""WITH {Q.VEC}, f AS (SELECT DISTINCT speaker, session AS fold FROM uv), b AS (SELECT unnest([1, 2, 5, 10, 20, 9223372036854775807]) AS budget),
 en AS (SELECT f.speaker, fold, vec_id, row_number() OVER (PARTITION BY f.speaker, fold ORDER BY vec_id) AS r FROM f JOIN uv ON uv.speaker = f.speaker AND session <> fold),
 bt AS (SELECT budget, claimed, fold, {_U('c')} AS c FROM (SELECT budget, claimed, fold, list(x ORDER BY d) AS c FROM (SELECT budget, en.speaker AS claimed, fold, d, avg(x) AS x FROM en JOIN dims USING (vec_id) JOIN b ON r <= budget GROUP BY ALL) GROUP BY ALL)),
 bs AS (SELECT budget, speaker = claimed AS is_genuine, list_dot_product(v, c) AS score FROM uv JOIN bt ON speaker <> claimed OR session = fold), {Q.curve('bs', 'budget')}, {Q.metrics('budget')}
 SELECT budget, eer_nearest AS eer, genuine_mean FROM mt JOIN (SELECT budget, avg(score) FILTER (is_genuine) AS genuine_mean FROM bs GROUP BY ALL) USING (budget)""")
def budget_curve(spark, sf):
    """EER when only the first n enrolment vectors are used; budgets are a group column."""
    u = units(spark, sf)
    folds = small_side(u.select(F.col("speaker").alias("claimed"), F.col("session").alias("fold")).distinct())
    en = u.join(folds, (F.col("speaker") == F.col("claimed")) & (F.col("session") != F.col("fold"))).withColumn("_b", F.floor(F.col("vec_id") / 4096))
    r = rank_within(en, ["claimed", "fold"], "_b", ["vec_id"], "rn")
    budgets = F.array(*[F.lit(b).cast("long") for b in (1, 2, 5, 10, 20, ALL)])
    r = r.withColumn("budget", F.explode(budgets)).filter("rn <= budget")
    t = V.centroids(r, ["budget", "claimed", "fold"]).select("budget", "claimed", "fold", "c")
    sized = folds.select("claimed", "fold").withColumn("b", F.explode(budgets))
    pairs = V.each_with_each(u, t, sized, ["budget", "claimed", "fold"], ["vec_id"])
    s = pairs.filter((F.col("speaker") != F.col("claimed")) | (F.col("session") == F.col("fold"))).select(
        "budget", (F.col("speaker") == F.col("claimed")).alias("is_genuine"), V.dot(F.col("v"), F.col("c")).alias("score")).transform(hold)
    mean = s.groupBy("budget").agg(F.avg(F.when(F.col("is_genuine"), F.col("score"))).alias("genuine_mean"))
    return C.metrics(s, ["budget"]).withColumn("eer", F.col("eer_nearest")).join(mean, "budget")


_STAB = f"""{Q.CHOICE}, {Q.CLS}, un AS (SELECT utt, row_number() OVER (PARTITION BY speaker ORDER BY utt) AS r FROM utt WHERE session < 3),
 bud AS (SELECT unnest([3, 6, 9223372036854775807]) AS budget), en AS (SELECT ch.* REPLACE (budget || '/' || speaker AS speaker) FROM ch JOIN un USING (utt) JOIN bud ON r <= budget), pr AS (SELECT * FROM ch WHERE session = 3),
 {Q.cells('en', 'speaker', 'ecl')}, {Q.dense('ecl', 'speaker', 'edn')}, {Q.smooth('edn', 'speaker', 'eg')},
 edb AS (SELECT *, split_part(speaker, '/', 1) AS budget FROM edn), {Q.loo('edb', 'speaker', 'eloo', 'budget')}, {Q.smooth('eloo', 'speaker', 'ebg')}, {Q.ratios('eg', 'ebg', 'speaker', 'mo')}, {Q.cells('pr', 'utt, speaker', 'pcl')},
 {Q.mixing('en', "(SELECT DISTINCT speaker FROM en)", 'speaker', 'emx')}, {Q.mixing('pr', '(SELECT utt FROM utt WHERE session = 3)', 'utt', 'pmx')}, {Q.streams()}, {Q.mixed()},
 sb AS (SELECT split_part(claimed, '/', 1)::BIGINT AS budget, probe_speaker = split_part(claimed, '/', 2) AS is_genuine, score FROM lt WHERE score IS NOT NULL), {Q.curve('sb', 'budget')}, {Q.metrics('budget')}"""


@query("stability_curve", "budget:l n_gen:l n_imp:l eer:d", f"WITH {_STAB} SELECT * FROM mt WHERE n_gen >= 5 AND n_imp >= 5")
def stability_curve(spark, sf):
    """Graphs rebuilt from the first n enrolment utterances; budgets are a group column through the whole scorer."""
    enrol, probe = enrol_probe(spark, sf)
    u = enrol.select("utt", "speaker").distinct().withColumn("_b", F.floor(F.col("utt") / 4096))
    n = rank_within(u, ["speaker"], "_b", ["utt"], "rn").select("utt", "rn")
    budgets = F.array(*[F.lit(b).cast("long") for b in (3, 6, ALL)])
    e = enrol.join(n, "utt").withColumn("budget", F.explode(budgets)).filter("rn <= budget").drop("rn").transform(hold)
    s = L.streams(probe, e, L.models(e, ["budget", "speaker"]), ["budget"])
    t = L.with_score(L.mix_streams(s))
    return C.metrics(t, ["budget"]).filter("n_gen >= 5 and n_imp >= 5")


ABLATIONS = {"full": L.StreamWeights(), "no transition": L.StreamWeights().without("transition"), "no metrics": L.StreamWeights().without("metrics"), "no lexical": L.StreamWeights().without("lexical")}
_ABL = Q.SPEECH + ", " + Q.streams() + ", " + Q.streams("sl", low=True) + ", al AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS config, 1 AS zn, * FROM ({Q.mixed('st', 'z', w.lexical, w.transition, w.metrics)[6:-1]})" for n, w in ABLATIONS.items()) + f"""
 UNION ALL SELECT 'no z-norm', 0, * FROM ({Q.mixed('st', 'z')[6:-1]}) UNION ALL SELECT 'low-signal in', 1, * FROM ({Q.mixed('sl', 'z')[6:-1]})),
 {Q.parts('al', 'probe_speaker', 'claimed')}, zs AS (SELECT config, claimed, CASE WHEN count(*) < 2 THEN 0 ELSE avg(raw) END AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(raw) > 1e-6 THEN stddev_samp(raw) ELSE 1 END AS std
  FROM sp WHERE NOT is_genuine AND probe_dev GROUP BY ALL), zt AS (SELECT config, is_genuine, CASE WHEN score IS NULL THEN NULL WHEN zn = 0 THEN score ELSE 1 / (1 + exp(-((raw - coalesce(mean, 0)) / coalesce(std, 1)) / 1.5::DOUBLE)) END AS score
  FROM sp LEFT JOIN zs USING (config, claimed) WHERE part = 'test'), {Q.curve('zt', 'config')}, {Q.metrics('config')}"""


@query("ablate_scoring", "config eer:d delta:d", f"WITH {_ABL} SELECT config, eer, eer - (SELECT eer FROM mt WHERE config = 'full') AS delta FROM mt")
def ablate_scoring(spark, sf):
    """Streams are computed once and mixed per configuration; only the class set needs a second scoring pass."""
    enrol, probe = enrol_probe(spark, sf)
    models = L.models(enrol).transform(hold)
    s = L.streams(probe, enrol, models).transform(hold)
    low = L.streams(probe, enrol, models, low_signal=True)
    keep = ["config", "zn", "utt", "probe_speaker", "claimed", "is_genuine", "n_scored", "raw"]

    def row(df, name, w, zn):
        return L.mix_streams(df, w).withColumn("config", F.lit(name)).withColumn("zn", F.lit(zn)).select(*keep)

    out = row(low, "low-signal in", ABLATIONS["full"], True).unionByName(row(s, "no z-norm", ABLATIONS["full"], False))
    for name, w in ABLATIONS.items():
        out = out.unionByName(row(s, name, w, True))
    t = S.trial_parts(L.with_score(out), speakers=speaker_names(enrol, probe)).transform(hold)
    z = L.apply_znorm(t.withColumn("plain", F.col("score")), L.cohort_stats(t.filter("probe_dev"), ["config", "claimed"]), ["config", "claimed"])
    z = z.filter("part = 'test'").withColumn("score", F.when(F.col("zn"), F.col("score")).otherwise(F.col("plain")))
    m = C.metrics(z, ["config"]).select("config", "eer").transform(hold)
    base_eer = m.agg(F.max(F.when(F.col("config") == "full", F.col("eer"))).alias("b"))  # one row
    return m.join(F.broadcast(base_eer)).withColumn("delta", F.col("eer") - F.col("b"))


@query("evaluation_run", "part n_gen:l n_imp:l eer:d auc:d min_dcf:d", f"WITH {Q.ZN}, zf AS (SELECT * FROM zt WHERE part <> 'cohort'), {Q.curve('zf', 'part')}, {Q.metrics('part')} SELECT * FROM mt")
def evaluation_run(spark, sf):
    """The offline run end to end: tokens, graphs, trials, split, cohort normalisation, metrics on dev and test."""
    return C.metrics(llr_split(spark, sf).filter("part <> 'cohort'"), ["part"])


# ------------------------------------------------------------ vector screens

@query("outlier_clips", "vec_id:l speaker:l own:d outlier:b", f"""WITH {Q.VEC}, s AS (SELECT speaker, d, sum(x) AS x, count(*) AS n FROM dims GROUP BY ALL),
 r AS (SELECT m.vec_id, m.speaker, n, list(s.x - m.x ORDER BY m.d) AS rest FROM dims m JOIN s ON s.speaker = m.speaker AND s.d = m.d GROUP BY ALL)
 SELECT vec_id, r.speaker, list_dot_product(rest, v) / sqrt(list_dot_product(rest, rest)) AS own, list_dot_product(rest, v) / sqrt(list_dot_product(rest, rest)) < 0.3 AS outlier FROM r JOIN uv USING (vec_id) WHERE n >= 4""")
def outlier_clips(spark, sf):
    return V.own_rest_cosine(units(spark, sf), ["speaker"]).filter("n >= 4").withColumn("outlier", F.col("own") < 0.3)


@query("sitting_matrix", "speaker:l probe:l template:l mean:d", f"""WITH {Q.VEC}, s AS (SELECT speaker, session, d, sum(x) AS x, count(*) AS n FROM dims GROUP BY ALL),
 r AS (SELECT m.vec_id, m.speaker, m.session AS probe, s.session AS template, n, list(s.x - CASE WHEN s.session = m.session THEN m.x ELSE 0 END ORDER BY m.d) AS rest FROM dims m JOIN s ON s.speaker = m.speaker AND s.d = m.d GROUP BY ALL)
 SELECT r.speaker, probe, template, avg(CASE WHEN probe <> template OR n > 1 THEN list_dot_product(rest, v) / sqrt(list_dot_product(rest, rest)) END) AS mean FROM r JOIN uv USING (vec_id) GROUP BY ALL""")
def sitting_matrix(spark, sf):
    return V.sitting_matrix(units(spark, sf))


@query("near_dup_vectors", "vec_id:l match:l sim:d", f"""WITH {Q.VEC}, p AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) AS pos FROM uv), s AS (SELECT a.vec_id, b.vec_id AS mid, list_dot_product(a.v, b.v) AS sim FROM p a JOIN p b ON b.pos < a.pos AND b.pos >= a.pos - 2000)
 SELECT vec_id, arg_max(mid, (sim, -mid)) AS match, max(sim) AS sim FROM s GROUP BY ALL HAVING max(sim) >= 0.35""")
def near_dup_vectors(spark, sf):
    """Best of the 2,000 items before each arrival at or above a threshold (0.35 here, so that rows appear)."""
    return V.nearest_remembered(units(spark, sf), 2000, 0.35)


@query("identify", "vec_id:l best:l score:d correct:b", f"WITH {Q.CENT} SELECT vec_id, arg_max(claimed, (score, -claimed)) AS best, max(score) AS score, arg_max(claimed, (score, -claimed)) = any_value(probe_speaker) AS correct FROM ctrials GROUP BY ALL")
def identify(spark, sf):
    t = V.centroid_trials(units(spark, sf)).groupBy("vec_id", "probe_speaker").agg(F.max(F.struct("score", (-F.col("claimed")).alias("m"))).alias("b"))
    return t.select("vec_id", (-F.col("b.m")).alias("best"), F.col("b.score").alias("score"), (-F.col("b.m") == F.col("probe_speaker")).alias("correct"))


@query("nearest_impostors", "claimed:l probe_speaker:l top:d rank:l", f"WITH {Q.CENT} SELECT *, row_number() OVER (PARTITION BY claimed ORDER BY top DESC, probe_speaker) AS rank FROM (SELECT claimed, probe_speaker, max(score) AS top FROM ctrials WHERE NOT is_genuine GROUP BY claimed, probe_speaker) QUALIFY rank <= 5")
def nearest_impostors(spark, sf):
    t = V.centroid_trials(units(spark, sf)).filter("not is_genuine").groupBy("claimed", "probe_speaker").agg(F.max("score").alias("top"))
    return S.rank_first(t, ["claimed"], [F.desc("top"), "probe_speaker"], 5).withColumnRenamed("rn", "rank")


@query("admissible", "claimed:l n:l admissible:l rate:d", f"WITH {Q.CENT} SELECT claimed, count(*) AS n, count(*) FILTER (score >= 0.1) AS admissible, count(*) FILTER (score >= 0.1) / count(*)::DOUBLE AS rate FROM ctrials WHERE NOT is_genuine GROUP BY ALL")
def admissible(spark, sf):
    """Attack clips close enough to their target to count as attempts."""
    t = V.centroid_trials(units(spark, sf)).filter("not is_genuine")
    return t.groupBy("claimed").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.1).alias("admissible")).withColumn("rate", F.col("admissible") / F.col("n"))


@query("template_health", "speaker:l n:l consistency:d healthy:b missing:l", f"""WITH {Q.VEC}, p AS (SELECT a.speaker, avg(list_dot_product(a.v, b.v)) AS c FROM uv a JOIN uv b ON a.speaker = b.speaker AND a.vec_id <> b.vec_id GROUP BY ALL)
 SELECT speaker, count(*) AS n, any_value(c) AS consistency, any_value(c) >= 0.7 AS healthy, 3 - count(DISTINCT session) AS missing FROM uv JOIN p USING (speaker) GROUP BY ALL""")
def template_health(spark, sf):
    u = units(spark, sf)
    s = u.groupBy("speaker").agg((3 - F.count_distinct("session")).alias("missing"))
    return V.self_consistency(u, ["speaker"]).join(s, "speaker").withColumn("healthy", F.col("consistency") >= 0.7)


@query("branch_scores", "session:l probe_speaker:l claimed:l n:l score:d reason", f"WITH {Q.CENT} SELECT session, probe_speaker, claimed, count(*) AS n, CASE WHEN count(*) >= 3 THEN (avg(score) + 1) / 2 END AS score, CASE WHEN count(*) < 3 THEN 'too_few_clips' ELSE 'ok' END AS reason FROM ctrials GROUP BY ALL")
def branch_scores(spark, sf):
    """Mean cosine of a probe's clips to the claimed template on [0, 1], or the reason it is missing."""
    t = V.centroid_trials(units(spark, sf)).groupBy("session", "probe_speaker", "claimed").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    ok = F.col("n") >= 3
    return t.withColumn("score", F.when(ok, (F.col("m") + 1) / 2)).withColumn("reason", F.when(ok, "ok").otherwise("too_few_clips"))


@query("calibration_report", "kind grp:l n:l speakers:l mean:d low:d p99:d p999:d top:d rate:d", f"""WITH {Q.TRIALS}, c AS (SELECT CASE WHEN is_genuine THEN 'owner' ELSE 'strangers' END AS kind, fold AS grp, score, probe_speaker FROM trials)
 SELECT kind, grp, count(*) AS n, count(DISTINCT probe_speaker) AS speakers, avg(score) AS mean, min(score) AS low, quantile_cont(score, 0.99) AS p99, quantile_cont(score, 0.999) AS p999, max(score) AS top, avg((score >= 0.1)::INT) AS rate FROM c GROUP BY ALL""")
def calibration_report(spark, sf):
    """Owner scores per held-out session and stranger scores per fold, with their tails."""
    t = trials(spark, sf).select(F.when(F.col("is_genuine"), "owner").otherwise("strangers").alias("kind"), F.col("fold").alias("grp"), "score", "probe_speaker").transform(hold)
    q = exact_quantiles(t, ["kind", "grp"], "score", {"p99": 0.99, "p999": 0.999})
    return t.groupBy("kind", "grp").agg(F.count("*").alias("n"), F.count_distinct("probe_speaker").alias("speakers"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("top"), F.avg((F.col("score") >= 0.1).cast("int")).alias("rate")).join(q, ["kind", "grp"])
