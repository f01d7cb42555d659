"""Fusion, attack-table and operating-point queries over `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilens.functions.stats import wilson
from verilens.operators import curves as C
from verilens.operators import fusion as M
from verilens.operators import intervals as I
from verilens.operators import splits as S
from verilens.operators.scan import exact_quantiles
from verilens.plans import sqlviews as Q
from verilens.plans.registry import query
from verilens.sources import views
from verilens.sources.tables import table
from verilens.sources.held import hold

P = M.Policy()
ATT_W = M.weighted(P, M.ATTACK_CONFIGURATIONS)
CONF_W = M.weighted(P, M.CONFIGURATIONS)
FULL_W = {"full": CONF_W["full"]}


def with_configs(df, weights, veto=P.veto):
    return df.select("*", F.inline(M.configs(weights, veto)))


def scored(spark, sf, weights=None, veto=P.veto):
    """Verification trials fused under each configuration."""
    return M.fuse(with_configs(views.trial_scores(spark, sf), weights or CONF_W, veto))


def dev_test(spark, sf, df):
    return S.trial_parts(df)


@query("policy_weights", "config branch weight:d", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{b}', {x!r}::DOUBLE)" for c, w in CONF_W.items() for b, x in zip(M.BRANCHES, w)) + """) v(config, branch, weight)
 WHERE EXISTS (SELECT 1 FROM lineitem)""")
def policy_weights(spark, sf):
    """Weights of each configuration restricted to the branches its trials measured."""
    t = with_configs(views.trial_scores(spark, sf), CONF_W)
    seen = t.groupBy("config").agg(*[F.max(F.when(F.col(f"s_{b}").isNotNull(), F.col(f"w_{b}")).otherwise(0.0)).alias(b) for b in M.BRANCHES])
    total = F.col("voice") + F.col("graph") + F.col("know")
    return seen.select("config", F.expr("stack(3, 'voice', voice, 'graph', graph, 'know', know) AS (branch, w)"), total.alias("total")).select(
        "config", "branch", (F.col("w") / F.col("total")).alias("weight"))


@query("fused_scores", "config item:l line:l probe_speaker:l score:d vetoed:b", f"""WITH {Q.TS}, {Q.configs(CONF_W, P.veto)}, {Q.fused('ts')}
 SELECT config, item, line, probe_speaker, nullif(score, '-inf') AS score, score = '-inf' AS vetoed FROM fu""")
def fused_scores(spark, sf):
    veto = F.col("score") == M.VETOED
    return scored(spark, sf).select("config", "item", "line", "probe_speaker", F.when(~veto, F.col("score")).alias("score"), veto.alias("vetoed"))


_ATT = f"WITH {Q.ATT}, {Q.configs(ATT_W, P.veto)}, {Q.fused('att')}, {Q.decided('fu')}"


def attack_decisions(spark, sf):
    return M.decide(with_configs(views.attack_trials(spark, sf), ATT_W), P)


@query("fusion_decision", "item:l attack:l speaker:l decision reason fused:d", f"""WITH {Q.ATT}, {Q.configs(FULL_W, P.veto)},
 attp AS (SELECT *, CASE WHEN item % 3 = 0 THEN s_know + 0.3::DOUBLE END AS phrase FROM att), {Q.fused('attp')}, {Q.decided('fu', phrase=True)} SELECT * FROM de""")
def fusion_decision(spark, sf):
    t = views.attack_trials(spark, sf).withColumn("phrase", F.when(F.col("item") % 3 == 0, F.col("s_know") + 0.3))
    return M.decide(with_configs(t, FULL_W), P)


@query("voice_gate_decision", "item:l attack:l speaker:l decision reason fused:d", f"""WITH {Q.ATT}, {Q.configs(FULL_W, P.veto)}, {Q.fused('att')},
 g AS (SELECT *, CASE WHEN s_voice < 0.62 THEN mean + w_voice / ({Q._DEN}) * (0.62::DOUBLE - s_voice) ELSE mean END AS eff, s_voice < 0.62 AS grey FROM fu),
 r AS (SELECT *, CASE WHEN NOT liveness_ok THEN 'liveness' WHEN integrity < 0.25 THEN 'integrity' WHEN s_voice IS NULL THEN 'voice_missing'
  WHEN s_voice < 0.62::DOUBLE - 0.08::DOUBLE THEN 'voice' WHEN vetoed THEN 'veto' WHEN s_know < 0.7 THEN 'knowledge' WHEN abs(eff - 0.55) <= 0.05 THEN 'near'
  WHEN eff >= 0.55 - 1e-9 AND grey THEN 'grey' WHEN eff >= 0.55 THEN 'reached' ELSE 'below' END AS reason FROM g)
 SELECT *, CASE WHEN reason IN ('liveness', 'integrity', 'voice_missing', 'voice') THEN 0 ELSE mean END AS fused,
  CASE WHEN reason = 'reached' THEN 'ACCEPT' WHEN reason IN ('near', 'grey') THEN 'BORDERLINE' ELSE 'REJECT' END AS decision FROM r""")
def voice_gate_decision(spark, sf):
    """The live rule: the voice must pass on its own and a wrong answer rejects."""
    return M.decide(with_configs(views.attack_trials(spark, sf), FULL_W), M.Policy(voice_gate=True, require_knowledge=True))


def attack_cells(spark, sf):
    d = attack_decisions(spark, sf)
    ok = F.col("admissible")
    lo, hi = wilson(F.col("n_accepted"), F.col("n_trials"))
    return d.groupBy("attack", "config").agg(
        F.count_if(ok).alias("n_trials"), F.count_if(ok & (F.col("decision") == "ACCEPT")).alias("n_accepted"),
        F.count_if(ok & (F.col("decision") == "BORDERLINE")).alias("n_borderline"), F.count_if(~ok).alias("n_excluded"),
        F.count_if(ok & F.col("simulated")).alias("n_simulated"),
    ).withColumn("iapmr", F.when(F.col("n_trials") > 0, F.col("n_accepted") / F.col("n_trials")).otherwise(0.0)).withColumn("lo", lo).withColumn(
        "hi", hi).withColumn("underpowered", F.col("n_trials") < 30)


_WLO, _WHI = Q.wilson("n_accepted", "n_trials")
_CELLS = f"""{_ATT}, ce0 AS (SELECT attack, config, count(*) FILTER (admissible) AS n_trials, count(*) FILTER (admissible AND decision = 'ACCEPT') AS n_accepted,
 count(*) FILTER (admissible AND decision = 'BORDERLINE') AS n_borderline, count(*) FILTER (NOT admissible) AS n_excluded,
 count(*) FILTER (admissible AND simulated) AS n_simulated FROM de GROUP BY ALL),
ce AS (SELECT *, CASE WHEN n_trials > 0 THEN n_accepted / n_trials::DOUBLE ELSE 0 END AS iapmr, {_WLO} AS lo, {_WHI} AS hi, n_trials < 30 AS underpowered FROM ce0)"""
query("attack_cells", "attack:l config n_trials:l n_accepted:l n_borderline:l n_excluded:l n_simulated:l iapmr:d lo:d hi:d underpowered:b", _CELLS + " SELECT * FROM ce")(attack_cells)


@query("wilson", "attack:l n:l k:l lo:d hi:d", f"""WITH {Q.ATT}, w AS (SELECT attack, count(*) AS n_trials, count(*) FILTER (admissible) AS n_accepted FROM att GROUP BY ALL)
 SELECT attack, n_trials AS n, n_accepted AS k, {_WLO} AS lo, {_WHI} AS hi FROM w""")
def wilson_query(spark, sf):
    lo, hi = wilson(F.col("k"), F.col("n"))
    return views.attack_trials(spark, sf).groupBy("attack").agg(F.count(F.lit(1)).alias("n"), F.count_if("admissible").alias("k")).withColumn("lo", lo).withColumn("hi", hi)


@query("attack_readiness", "attack:l problem n:l", f"""{_CELLS} SELECT attack, 'simulated' AS problem, max(n_simulated) AS n FROM ce GROUP BY ALL HAVING max(n_simulated) > 0
 UNION ALL SELECT attack, 'underpowered', min(n_trials) FROM ce GROUP BY ALL HAVING min(n_trials) < 30
 UNION ALL SELECT attack, 'low_yield', min(n_trials) FROM ce GROUP BY ALL HAVING min(n_trials / (n_trials + n_excluded)::DOUBLE) < 0.82
 UNION ALL SELECT attack, 'template_only', count(*) FILTER (s_graph IS NULL) FROM att GROUP BY ALL HAVING count(*) FILTER (s_graph IS NULL) / count(*)::DOUBLE > 0.1""")
def attack_readiness(spark, sf):
    """Problems that keep an attack row out of a report (yield floor 0.82 here, so that rows appear)."""
    c = attack_cells(spark, sf).groupBy("attack").agg(
        F.max("n_simulated").alias("sim"), F.min("n_trials").alias("low"), F.min(F.col("n_trials") / (F.col("n_trials") + F.col("n_excluded"))).alias("yield"))

    # attempts that only the template judged, without the behaviour graph
    bare = views.attack_trials(spark, sf).groupBy("attack").agg(F.count_if(F.col("s_graph").isNull()).alias("n"), F.count("*").alias("_all")).filter("n / _all > 0.1").select("attack", F.lit("template_only").alias("problem"), "n")

    def row(cond, name, n):
        return F.when(cond, F.struct(F.lit(name).alias("problem"), n.alias("n")))

    return c.select("attack", F.inline(F.array_compact(F.array(
        row(F.col("sim") > 0, "simulated", F.col("sim")), row(F.col("low") < 30, "underpowered", F.col("low")),
        row(F.col("yield") < 0.82, "low_yield", F.col("low")))))).unionByName(bare)


@query("iapmr_by_speaker", "speaker:l n:l iapmr:d weighted_mean:d", f"""{_ATT}, b AS (SELECT speaker, count(*) AS n, avg((decision = 'ACCEPT')::INT) AS iapmr
 FROM de WHERE config = 'full' AND admissible GROUP BY ALL) SELECT s_suppkey AS speaker, coalesce(n, 0) AS n, iapmr,
 (SELECT sum(n * iapmr) / sum(n) FROM b) AS weighted_mean FROM supplier LEFT JOIN b ON speaker = s_suppkey""")
def iapmr_by_speaker(spark, sf):
    b = M.decide(with_configs(views.attack_trials(spark, sf).filter("admissible"), FULL_W), P).groupBy("speaker").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") == "ACCEPT").cast("int")).alias("iapmr"))
    mean = b.agg((F.sum(F.col("n") * F.col("iapmr")) / F.sum("n")).alias("weighted_mean"))  # one row
    reg = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("speaker"))
    return reg.join(b, "speaker", "left").join(F.broadcast(mean)).withColumn("n", F.coalesce("n", F.lit(0)))


@query("branch_coverage", "branch measured:l unavailable:l rate:d top_reason", f"""WITH {Q.ATT}, l AS (
 SELECT 'graph' AS branch, s_graph AS s, CASE WHEN item % 2 = 0 THEN 'too_few_tokens' ELSE 'no_model' END AS why FROM att
 UNION ALL SELECT 'integrity', integrity, CASE WHEN item % 3 = 0 THEN 'decode_failed' ELSE 'not_run' END FROM att),
 r AS (SELECT branch, why, count(*) AS n FROM l WHERE s IS NULL GROUP BY ALL)
 SELECT branch, count(s) AS measured, count(*) - count(s) AS unavailable, count(s) / count(*)::DOUBLE AS rate,
 (SELECT arg_max(why, (n, why)) FROM r WHERE r.branch = l.branch) AS top_reason FROM l GROUP BY ALL""")
def branch_coverage(spark, sf):
    even, third = F.col("item") % 2 == 0, F.col("item") % 3 == 0
    rows = F.array(
        F.struct(F.lit("graph").alias("branch"), F.col("s_graph").alias("s"), F.when(even, "too_few_tokens").otherwise("no_model").alias("why")),
        F.struct(F.lit("integrity").alias("branch"), F.col("integrity").alias("s"), F.when(third, "decode_failed").otherwise("not_run").alias("why")))
    by = views.attack_trials(spark, sf).select(F.inline(rows)).groupBy("branch", "why").agg(F.count("s").alias("m"), F.count_if(F.col("s").isNull()).alias("n"))
    return by.groupBy("branch").agg(
        F.sum("m").alias("measured"), F.sum("n").alias("unavailable"), (F.sum("m") / (F.sum("m") + F.sum("n"))).alias("rate"),
        F.max_by("why", F.struct("n", "why")).alias("top_reason"))


@query("history_eval", "config n_gen:l n_imp:l eer:d auc:d", f"""WITH {Q.ATT}, {Q.configs(FULL_W, P.veto)}, {Q.fused('att')}, {Q.decided('fu')},
 {Q.configs(ATT_W, P.veto, 'cfg2')}, lab AS (SELECT c.config, d.decision = 'ACCEPT' AS is_genuine, list_avg([CASE WHEN c.w_voice > 0 THEN s_voice END,
  CASE WHEN c.w_graph > 0 THEN s_graph END, CASE WHEN c.w_know > 0 THEN s_know END]) AS score FROM de d CROSS JOIN cfg2 c),
 {Q.curve('lab', 'config')}, {Q.metrics('config')} SELECT * FROM mt WHERE n_gen >= 5 AND n_imp >= 5""")
def history_eval(spark, sf):
    """Past decisions as labels: unweighted mean of each configuration's measured branches against the full decision."""
    d = M.decide(with_configs(views.attack_trials(spark, sf), FULL_W), P).withColumn("is_genuine", F.col("decision") == "ACCEPT")
    d = d.select("s_voice", "s_graph", "s_know", "is_genuine")
    t = with_configs(d, ATT_W)
    used = F.array_compact(F.array(*[F.when(F.col(f"w_{b}") > 0, F.col(f"s_{b}")) for b in M.BRANCHES]))
    mean = F.aggregate(used, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(used), F.lit(0))
    return C.metrics(t.withColumn("score", mean), ["config"]).filter("n_gen >= 5 and n_imp >= 5")


@query("reject_slices", "attribute value n:l reject_rate:d", f"""WITH {Q.ATT}, {Q.configs(FULL_W, P.veto)}, {Q.fused('att')}, {Q.decided('fu')},
 u AS (SELECT 'device' AS attribute, flag AS value, decision FROM de UNION ALL SELECT 'environment', status, decision FROM de
 UNION ALL SELECT 'attack', attack::VARCHAR, decision FROM de)
 SELECT attribute, value, count(*) AS n, avg((decision <> 'ACCEPT')::INT) AS reject_rate FROM u GROUP BY ALL HAVING count(*) >= 5""")
def reject_slices(spark, sf):
    d = M.decide(with_configs(views.attack_trials(spark, sf), FULL_W), P)
    u = d.select("decision", F.expr("stack(3, 'device', flag, 'environment', status, 'attack', cast(attack as string)) AS (attribute, value)"))
    return u.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") != "ACCEPT").cast("int")).alias("reject_rate")).filter("n >= 5")


@query("gate_effect", "attack:l caught:d worst_gated:d worst_open:d", f"""{_ATT}, op AS (SELECT *, CASE WHEN liveness_ok AND NOT vetoed AND mean > 0.55 + 0.05 AND mean >= 0.55 THEN 1 ELSE 0 END AS acc FROM fu),
 r AS (SELECT attack, config, avg(acc) AS open FROM op WHERE admissible GROUP BY ALL), g AS (SELECT attack, config, avg((decision = 'ACCEPT')::INT) AS gated FROM de WHERE admissible GROUP BY ALL),
 c AS (SELECT attack, avg((integrity < 0.25)::INT) AS caught FROM att WHERE integrity IS NOT NULL GROUP BY ALL)
 SELECT attack, any_value(caught) AS caught, min(gated) AS worst_gated, min(open) AS worst_open FROM r JOIN g USING (attack, config) JOIN c USING (attack) GROUP BY ALL""")
def gate_effect(spark, sf):
    """Share of attacks the integrity gate catches, and the best configuration's acceptance with the gate on and off."""
    t = with_configs(views.attack_trials(spark, sf), ATT_W).withColumn("integrity_measured", F.col("integrity"))
    both = t.select(*[c for c in t.columns if c != "integrity"], F.inline(F.array(
        F.struct(F.lit(True).alias("gate"), F.col("integrity").alias("integrity")), F.struct(F.lit(False).alias("gate"), F.lit(None).cast("double").alias("integrity")))))
    cell = M.decide(both, P).groupBy("attack", "config", "gate").agg(
        F.avg(F.when(F.col("admissible"), (F.col("decision") == "ACCEPT").cast("int"))).alias("rate"),
        F.avg((F.col("integrity_measured") < P.integrity_floor).cast("int")).alias("caught"))
    return cell.groupBy("attack").agg(F.max("caught").alias("caught"), F.min(F.when(F.col("gate"), F.col("rate"))).alias("worst_gated"), F.min(F.when(~F.col("gate"), F.col("rate"))).alias("worst_open"))


_CONF = f"WITH {Q.TS}, {Q.configs(CONF_W, P.veto)}, {Q.fused('ts')}, {Q.curve('fu', 'config')}, {Q.metrics('config')}"


@query("configurations", "config n_gen:l n_imp:l n_vetoed:l eer:d min_dcf:d far_at_frr_1pct:d frr_at_far_1pct:d auc:d", _CONF + " SELECT *, veto_gen + veto_imp AS n_vetoed FROM mt")
def configurations(spark, sf):
    return C.metrics(scored(spark, sf), ["config"]).withColumn("n_vetoed", F.col("veto_gen") + F.col("veto_imp"))


@query("metric_bundle", "config n_points:l reliable:b point:l t:d far:d frr:d", _CONF + """, ix AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY t) - 1 AS ix,
 count(*) OVER (PARTITION BY config) AS np FROM cv), pick AS (SELECT config, p, CASE WHEN np > 200 THEN floor(p * (np - 1) / 199.0::DOUBLE)::BIGINT ELSE p END AS ix, np FROM
 (SELECT config, any_value(np) AS np FROM ix GROUP BY ALL) CROSS JOIN range(200) r(p) WHERE p < np)
 SELECT config, np AS n_points, n_gen >= 30 AND n_imp >= 30 AS reliable, p AS point, t, far, frr FROM pick JOIN ix USING (config, ix) JOIN mt USING (config)""".replace("n_gen >= 30 AND n_imp >= 30", "mt.n_gen >= 30 AND mt.n_imp >= 30").replace("np AS n_points", "pick.np AS n_points").replace(" t, far, frr FROM pick", " ix.t, ix.far, ix.frr FROM pick"))
def metric_bundle(spark, sf):
    """At most 200 evenly spaced points of each configuration's curve, for plotting; metrics use the full curve."""
    from verilens.operators.scan import rank_within, value_bucket

    cv = C.curve(scored(spark, sf), ["config"]).withColumn("_b", value_bucket(F.col("t")))
    r = rank_within(cv, ["config"], "_b", ["t"], "rn", "np")
    ix, last = F.col("rn") - 1, F.col("np") - 1
    # index floor(p * last / 199) is hit when p is the first integer with p * last >= ix * 199
    p = F.ceil(ix * 199.0 / last)
    hit = F.filter(F.array(p - 1, p, p + 1), lambda q: (q >= 0) & (q <= 199) & (F.floor(q * last / 199.0) == ix))
    point = F.when(F.col("np") > 200, F.get(hit, F.lit(0))).otherwise(ix)
    return r.withColumn("point", point).filter("point is not null").select(
        "config", F.col("np").alias("n_points"), ((F.col("g") >= 30) & (F.col("i") >= 30)).alias("reliable"), "point", "t", "far", "frr")


ABL = {"full": CONF_W["full"], "no veto": CONF_W["full"], "equal weights": (1 / 3, 1 / 3, 1 / 3)}
ABL_V = {"full": P.veto, "no veto": None, "equal weights": P.veto}


@query("ablate_policy", "config eer:d delta:d", f"""WITH {Q.TS}, {Q.configs(ABL, ABL_V)}, {Q.fused('ts')}, {Q.curve('fu', 'config')}, {Q.metrics('config')}
 SELECT config, eer, eer - (SELECT eer FROM mt WHERE config = 'full') AS delta FROM mt""")
def ablate_policy(spark, sf):
    """Re-fused trials with one switch changed; a positive delta means the removed part was helping."""
    m = C.metrics(scored(spark, sf, ABL, ABL_V), ["config"]).select("config", "eer")
    base = m.agg(F.max(F.when(F.col("config") == "full", F.col("eer"))).alias("base"))  # one row
    return m.join(F.broadcast(base)).withColumn("delta", F.col("eer") - F.col("base"))


GRID = [round(0.05 + 0.025 * k, 3) for k in range(40)]


def split_scores(spark, sf, weights=FULL_W, veto=None):
    return S.trial_parts(M.fuse(with_configs(views.trial_scores(spark, sf), weights, veto)))


_SPLIT = f"WITH {Q.TS}, {Q.configs(FULL_W, None)}, {Q.fused('ts')}, {Q.parts('fu', 'probe_speaker', 'claimed')}"
_FIT = f"""{_SPLIT}, dv AS (SELECT * FROM sp WHERE part = 'dev'), {Q.curve('dv', 'config')}, {Q.metrics('config')},
 grid AS (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS floor),
 sw AS (SELECT floor, count(*) FILTER (NOT is_genuine AND score >= mt.eer_t AND s_graph < floor) / (count(*) FILTER (NOT is_genuine))::DOUBLE AS far_removed,
  count(*) FILTER (is_genuine AND score >= mt.eer_t AND s_graph < floor) / (count(*) FILTER (is_genuine))::DOUBLE AS frr_cost, any_value(mt.eer_t) AS thr FROM dv CROSS JOIN mt CROSS JOIN grid GROUP BY floor)"""


def fitted(spark, sf):
    """Dev trials with the threshold fitted on dev attached (one row)."""
    dev = split_scores(spark, sf).filter("part = 'dev'").transform(hold)
    thr = C.metrics(dev, ["config"]).select(F.col("eer_t").alias("threshold"))
    return dev.join(F.broadcast(thr))


_BEST = "best AS (SELECT * FROM sw WHERE floor < thr AND frr_cost <= {b} AND far_removed > 0 ORDER BY floor DESC LIMIT 1)"


def fit(spark, sf, budget):
    sweep = M.veto_sweep(fitted(spark, sf), F.col("threshold"), GRID, ["threshold"])
    return M.veto_fit(sweep, F.col("threshold"), budget, ["threshold"])


@query("veto_fit", "floor:d far_removed:d frr_cost:d", f"{_FIT}, {_BEST.format(b=0.15)} SELECT floor, far_removed, frr_cost FROM best")
def veto_fit(spark, sf):
    """Highest floor inside a 15% reject budget (graph scores here take nine values, so each step is wide)."""
    return fit(spark, sf, 0.15)


#: Seeds of the dev split for which weights are fitted.
SEEDS = (0, 1, 2)


def _seed_parts(seed: int) -> str:
    return f"SELECT {seed} AS seed, t.* FROM ts t JOIN sk_{seed} a ON a.k = probe_speaker AND a.dev JOIN sk_{seed} b ON b.k = claimed AND b.dev"


_DEV_ALL = f"""WITH {Q.TS}, sk AS (SELECT DISTINCT k FROM (SELECT probe_speaker AS k FROM ts UNION ALL SELECT claimed FROM ts)), """ + ", ".join(
    f"sk_{s} AS (SELECT k, row_number() OVER (ORDER BY md5('{s}|' || k), k) <= least(greatest(2, round_even(n * 0.4::DOUBLE, 0)), n - 2) AS dev FROM sk, (SELECT count(*) AS n FROM sk) WHERE n >= 4)" for s in SEEDS) + f""",
 da AS ({" UNION ALL ".join(_seed_parts(s) for s in SEEDS)}), {M.sql_fit('fw', 'da', 'seed')}"""


def dev_of_seeds(spark, sf):
    """Dev trials of each seed's speaker split."""
    t = views.trial_scores(spark, sf)
    out = None
    for seed in SEEDS:
        d = S.trial_parts(t, seed=seed).filter("part = 'dev'").withColumn("seed", F.lit(seed))
        out = d if out is None else out.unionByName(d)
    return out


@query("fusion_weights", "seed:l branch weight:d coef:d", _DEV_ALL + " SELECT seed, unnest(['voice', 'graph', 'know']) AS branch, unnest([w_voice, w_graph, w_know]) AS weight, unnest([c0, c1, c2]) AS coef FROM fw")
def fusion_weights(spark, sf):
    """Weights fitted on the dev part alone, for every seed of the split at once."""
    return M.fit_weights(dev_of_seeds(spark, sf), ["seed"])


_FITTED = f"""{_DEV_ALL}, cfg AS (SELECT 'fitted' AS config, 0 AS ord, w_voice, w_graph, w_know, NULL::DOUBLE AS veto FROM fw WHERE seed = 0), {Q.fused('ts')}, {Q.parts('fu', 'probe_speaker', 'claimed')},
 dv AS (SELECT * FROM sp WHERE part = 'dev'), {Q.curve('dv', 'config')}, {Q.metrics('config')}, grid AS (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS floor),
 sw AS (SELECT floor, count(*) FILTER (NOT is_genuine AND score >= mt.eer_t AND s_graph < floor) / (count(*) FILTER (NOT is_genuine))::DOUBLE AS far_removed,
  count(*) FILTER (is_genuine AND score >= mt.eer_t AND s_graph < floor) / (count(*) FILTER (is_genuine))::DOUBLE AS frr_cost, any_value(mt.eer_t) AS thr FROM dv CROSS JOIN mt CROSS JOIN grid GROUP BY floor)"""


@query("fit_policy", "threshold:d floor:d far_removed:d frr_cost:d", f"""{_FITTED}, {_BEST.format(b=0.02)}
 SELECT mt.eer_t AS threshold, floor, coalesce(far_removed, 0) AS far_removed, coalesce(frr_cost, 0) AS frr_cost FROM mt LEFT JOIN best ON true""")
def fit_policy(spark, sf):
    """Weights on dev first, then the threshold under them, then the veto floor under both."""
    dev = S.trial_parts(views.trial_scores(spark, sf)).filter("part = 'dev'").transform(hold)
    w = {r.branch: r.weight for r in M.fit_weights(dev).collect()}  # three numbers
    fused = M.fuse(with_configs(dev, {"fitted": (w["voice"], w["graph"], w["know"])}, None)).transform(hold)
    thr = C.metrics(fused, ["config"]).select(F.col("eer_t").alias("threshold"))
    sweep = M.veto_sweep(fused.join(F.broadcast(thr)), F.col("threshold"), GRID, ["threshold"])  # one row
    return M.veto_fit(sweep, F.col("threshold"), 0.02, ["threshold"])


@query("threshold_rules", "config thr_eer:d far1:d far01:d", _CONF + """, k AS (SELECT config, score, row_number() OVER (PARTITION BY config ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY config) AS n FROM fu WHERE NOT is_genuine)
 SELECT config, thr_eer, (SELECT nullif(score, '-inf') FROM k WHERE k.config = mt.config AND r = least(floor(0.01::DOUBLE * n), n - 1) + 1) AS far1,
 (SELECT nullif(score, '-inf') FROM k WHERE k.config = mt.config AND r = least(floor(0.001::DOUBLE * n), n - 1) + 1) AS far01 FROM mt""")
def threshold_rules(spark, sf):
    """EER threshold and the impostor order statistics behind FAR targets (accept strictly above)."""
    return C.metrics(scored(spark, sf), ["config"], far_targets={"far1": 0.01, "far01": 0.001})


@query("fairness_eer", "condition grp n_gen:l n_imp:l eer:d", f"""WITH {Q.TS}, {Q.configs(FULL_W, P.veto)}, {Q.fused('ts')},
 u AS (SELECT 'device' AS condition, device AS grp, is_genuine, score FROM fu UNION ALL SELECT 'region', region::VARCHAR, is_genuine, score FROM fu),
 {Q.curve('u', 'condition, grp')}, {Q.metrics('condition, grp')} SELECT * FROM mt WHERE n_gen >= 20 AND n_imp >= 20""")
def fairness_eer(spark, sf):
    u = scored(spark, sf, FULL_W).select("is_genuine", "score", F.expr("stack(2, 'device', device, 'region', cast(region as string)) AS (condition, grp)"))
    return C.metrics(u, ["condition", "grp"]).filter("n_gen >= 20 and n_imp >= 20")


@query("score_histogram", "config bin:l n_gen:l n_imp:l n_vetoed:l", f"""WITH {Q.TS}, {Q.configs(CONF_W, P.veto)}, {Q.fused('ts')},
 r AS (SELECT config, min(score) FILTER (score > '-inf') AS lo, max(score) AS hi FROM fu GROUP BY ALL)
 SELECT config, CASE WHEN score = '-inf' THEN -1 ELSE least(39, floor((score - lo) / (hi - lo) * 40)) END AS bin, count(*) FILTER (is_genuine) AS n_gen,
 count(*) FILTER (NOT is_genuine) AS n_imp, count(*) FILTER (score = '-inf') AS n_vetoed FROM fu JOIN r USING (config) GROUP BY ALL""")
def score_histogram(spark, sf):
    """40 equal bins between the lowest and highest finite score; vetoed trials in bin -1."""
    h = C.histogram(scored(spark, sf), ["config"]).transform(hold)
    fin = F.col("t") > C.NEG_INF
    r = h.groupBy("config").agg(F.min(F.when(fin, F.col("t"))).alias("lo"), F.max("t").alias("hi"))  # a row per configuration
    b = F.when(~fin, F.lit(-1)).otherwise(F.least(F.lit(39), F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 40)))
    n = F.col("n_gen") + F.col("n_imp")
    return h.join(F.broadcast(r), "config").withColumn("bin", b).groupBy("config", "bin").agg(
        F.sum("n_gen").alias("n_gen"), F.sum("n_imp").alias("n_imp"), F.sum(F.when(~fin, n).otherwise(0)).alias("n_vetoed"))


_OP_FAR, _OP_FRR = Q.wilson("fa", "ni"), Q.wilson("fr", "ng")


@query("operating_point", "device threshold:d floor:d far_t:d far_lo:d far_hi:d frr_t:d frr_lo:d frr_hi:d far_floor:d frr_floor:d provisional:b ready:b", f"""WITH {Q.TS}, {Q.configs(FULL_W, None)}, {Q.fused('ts')},
 s AS (SELECT device, count(*) FILTER (NOT is_genuine) AS ni, count(*) FILTER (is_genuine) AS ng, quantile_cont(score, 0.99) FILTER (NOT is_genuine) AS q,
  max(score) FILTER (NOT is_genuine) AS mx, quantile_cont(score, 0.01) FILTER (is_genuine) AS owner FROM fu WHERE score > '-inf' GROUP BY ALL),
 e AS (SELECT *, CASE WHEN ni * 0.01 >= 5 THEN q ELSE greatest(q, mx) END AS edge FROM s),
 t AS (SELECT *, greatest(CASE WHEN owner - edge >= 0.04 THEN edge + 0.6 * (owner - edge) ELSE edge END, 0.55) AS thr0,
  CASE WHEN owner - edge >= 0.04 THEN edge + 0.6 * (owner - edge) - greatest(0.02, 0.3 * (owner - edge)) ELSE least(owner, edge - 0.02) END AS fl0 FROM e),
 p AS (SELECT device, thr0 AS threshold, greatest(least(fl0, thr0 - 0.02), 0) AS floor, ni * 0.01 < 5 OR ng < 30 AS provisional FROM t),
 r AS (SELECT device, threshold, floor, provisional, count(*) FILTER (is_genuine) AS ng, count(*) FILTER (NOT is_genuine) AS ni, count(*) FILTER (NOT is_genuine AND score >= threshold) AS fa, count(*) FILTER (is_genuine AND score < threshold) AS fr,
  count(*) FILTER (NOT is_genuine AND score >= floor) AS fa_f, count(*) FILTER (is_genuine AND score < floor) AS fr_f FROM fu JOIN p USING (device) WHERE score > '-inf' GROUP BY ALL)
 SELECT *, fa / ni::DOUBLE AS far_t, {_OP_FAR[0]} AS far_lo, {_OP_FAR[1]} AS far_hi, fr / ng::DOUBLE AS frr_t, {_OP_FRR[0]} AS frr_lo, {_OP_FRR[1]} AS frr_hi, fa_f / ni::DOUBLE AS far_floor, fr_f / ng::DOUBLE AS frr_floor,
 fr / ng::DOUBLE <= 0.05 AND NOT provisional AS ready FROM r""")
def operating_point(spark, sf):
    """Threshold between the strangers' tail and the owner's low end, with a band under it (FAR target 1%)."""
    # one histogram serves quantiles, counts and rates
    t = scored(spark, sf, FULL_W, None).filter(F.col("score") > C.NEG_INF).groupBy("device", "is_genuine", "score").agg(F.count("*").alias("c")).transform(hold)
    imp = exact_quantiles(t.filter(~F.col("is_genuine")), ["device"], "score", {"q": 0.99, "mx": 1.0}, F.col("c"))
    gen = exact_quantiles(t.filter("is_genuine"), ["device"], "score", {"owner": 0.01}, F.col("c"))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    g = F.col("is_genuine")
    n = t.groupBy("device").agg(some(g).alias("ng"), some(~g).alias("ni"))
    e = n.join(imp, "device").join(gen, "device")
    enough = F.col("ni") * 0.01 >= 5
    e = e.withColumn("edge", F.when(enough, F.col("q")).otherwise(F.greatest("q", "mx")))
    gap = F.col("owner") - F.col("edge")
    thr = F.when(gap >= 0.04, F.col("edge") + 0.6 * gap).otherwise(F.col("edge"))
    e = e.withColumn("fl0", F.when(gap >= 0.04, thr - F.greatest(F.lit(0.02), (thr - F.col("edge")) / 2)).otherwise(F.least(F.col("owner"), F.col("edge") - 0.02)))
    e = e.withColumn("threshold", F.greatest(thr, F.lit(0.55))).withColumn("floor", F.greatest(F.least(F.col("fl0"), F.col("threshold") - 0.02), F.lit(0.0)))
    p = e.select("device", "threshold", "floor", "ng", "ni", (~enough | (F.col("ng") < 30)).alias("provisional"))
    at = lambda edge: (some(~g & (F.col("score") >= F.col(edge))), some(g & (F.col("score") < F.col(edge))))
    (fa, fr), (fa_f, fr_f) = at("threshold"), at("floor")
    r = t.join(p, "device").groupBy("device", "threshold", "floor", "ng", "ni", "provisional").agg(fa.alias("fa"), fr.alias("fr"), fa_f.alias("fa_f"), fr_f.alias("fr_f"))
    (far_lo, far_hi), (frr_lo, frr_hi) = wilson(F.col("fa"), F.col("ni")), wilson(F.col("fr"), F.col("ng"))
    return r.select(
        "device", "threshold", "floor", "provisional", (F.col("fa") / F.col("ni")).alias("far_t"), far_lo.alias("far_lo"), far_hi.alias("far_hi"), (F.col("fr") / F.col("ng")).alias("frr_t"), frr_lo.alias("frr_lo"), frr_hi.alias("frr_hi"),
        (F.col("fa_f") / F.col("ni")).alias("far_floor"), (F.col("fr_f") / F.col("ng")).alias("frr_floor"), ((F.col("fr") / F.col("ng") <= 0.05) & ~F.col("provisional")).alias("ready"))


@query("floor_sweep", "attack:l floor:d frr:d detection:d feasible:b", f"""WITH {Q.ATT}, grid AS (SELECT i / 100.0::DOUBLE AS floor FROM range(101) r(i)),
 s AS (SELECT attack, floor, avg((integrity < floor)::INT) FILTER (liveness_ok) AS frr, avg((integrity < floor)::INT) FILTER (NOT liveness_ok) AS det
  FROM att CROSS JOIN grid WHERE integrity IS NOT NULL GROUP BY ALL)
 SELECT attack, arg_max(floor, (det, -floor)) AS floor, arg_max(frr, (det, -floor)) AS frr, max(det) AS detection, true AS feasible FROM s WHERE frr <= 0.05 GROUP BY ALL""")
def floor_sweep(spark, sf):
    """Lowest floor with the best detection inside the false-reject budget (5% here). Trials fall into grid slots first."""
    slot = F.floor(F.col("integrity") * 100 + 1e-9).cast("int")  # integrity < k / 100 iff slot < k
    a = views.attack_trials(spark, sf).filter("integrity is not null").groupBy("attack", slot.alias("slot")).agg(
        F.count_if("liveness_ok").alias("g"), F.count_if(~F.col("liveness_ok")).alias("t"))
    packed = a.groupBy("attack").agg(F.collect_list(F.struct("slot", "g", "t")).alias("cells"), F.sum("g").alias("ng"), F.sum("t").alias("nt"))
    k = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k"))

    def under(f):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(c["slot"] < F.col("k"), c[f]).otherwise(F.lit(0)))

    sweep = k.select("attack", (F.col("k") / 100.0).alias("floor"), (under("g") / F.col("ng")).alias("frr"), F.coalesce(under("t") / F.col("nt"), F.lit(0.0)).alias("det"))
    best = F.max(F.when(F.col("frr") <= 0.05, F.struct("det", (-F.col("floor")).alias("nf"), "frr")))
    return sweep.groupBy("attack").agg(best.alias("b")).select(
        "attack", F.coalesce(-F.col("b.nf"), F.lit(0.0)).alias("floor"), F.col("b.frr").alias("frr"), F.coalesce("b.det", F.lit(0.0)).alias("detection"), F.col("b").isNotNull().alias("feasible"))


_CUES = """cues AS (SELECT attack, flag <> 'R' AS genuine, flag, 'voice' AS cue, s_voice AS x FROM att UNION ALL SELECT attack, flag <> 'R', flag, 'integrity', integrity FROM att WHERE integrity IS NOT NULL
 UNION ALL SELECT attack, flag <> 'R', flag, 'know', s_know FROM att)"""


def cues(spark, sf):
    return views.attack_trials(spark, sf).select(
        "attack", "flag", (F.col("flag") != "R").alias("genuine"), F.expr("stack(3, 'voice', s_voice, 'integrity', integrity, 'know', s_know) AS (cue, x)")).filter("x is not null")


@query("tpr_at_fpr", "cue threshold:d tpr:d", f"""WITH {Q.ATT}, {_CUES}, q AS (SELECT cue, quantile_cont(x, 0.95) FILTER (genuine) AS threshold FROM cues GROUP BY ALL)
 SELECT cue, threshold, avg((x > threshold)::INT) FILTER (NOT genuine) AS tpr FROM cues JOIN q USING (cue) GROUP BY ALL""")
def tpr_at_fpr(spark, sf):
    c = cues(spark, sf)
    q = exact_quantiles(c.filter("genuine"), ["cue"], "x", {"threshold": 0.95})
    return c.filter(~F.col("genuine")).join(q, "cue").groupBy("cue", "threshold").agg(F.avg((F.col("x") > F.col("threshold")).cast("int")).alias("tpr"))


@query("cue_calibration", "cue kind:l median:d p95:d auc:d tpr1:d tpr5:d", f"""WITH {Q.ATT}, {_CUES},
 q AS (SELECT cue, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM cues WHERE genuine GROUP BY ALL),
 tc AS (SELECT cue, kind, NOT genuine AS is_genuine, x AS score FROM cues, (SELECT DISTINCT attack AS kind FROM att) k WHERE genuine OR attack = kind),
 {Q.curve('tc', 'cue, kind')}, {Q.metrics('cue, kind')}
 SELECT m.cue, m.kind, median, p95, auc, tpr1, tpr5 FROM mt m JOIN q USING (cue) JOIN (SELECT cue, attack AS kind, avg((x > p99)::INT) AS tpr1, avg((x > p95)::INT) AS tpr5 FROM cues JOIN q USING (cue) WHERE NOT genuine GROUP BY ALL) z ON z.cue = m.cue AND z.kind = m.kind""")
def cue_calibration(spark, sf):
    """Each cue's genuine spread and how well it separates each kind of tampering."""
    c = cues(spark, sf).groupBy("cue", "genuine", "attack", "x").agg(F.count(F.lit(1)).alias("w")).transform(hold)
    rows = cues(spark, sf)
    q = exact_quantiles(rows.filter("genuine"), ["cue"], "x", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    kinds = F.array(*[F.lit(k).cast("long") for k in range(1, 8)])
    kind = F.when(F.col("genuine"), kinds).otherwise(F.array("attack"))
    t = rows.select("cue", F.explode(kind).alias("kind"), (~F.col("genuine")).alias("is_genuine"), F.col("x").alias("score"))
    m = C.metrics(t, ["cue", "kind"]).select("cue", "kind", "auc")
    z = c.filter(~F.col("genuine")).join(q, "cue").groupBy("cue", F.col("attack").alias("kind"), "median", "p95").agg(
        (F.sum(F.when(F.col("x") > F.col("p99"), F.col("w")).otherwise(0)) / F.sum("w")).alias("tpr1"), (F.sum(F.when(F.col("x") > F.col("p95"), F.col("w")).otherwise(0)) / F.sum("w")).alias("tpr5"))
    return m.join(z, ["cue", "kind"])


@query("cue_fit", "cue threshold:d separation:d", f"""WITH {Q.ATT}, {_CUES}, l AS (SELECT cue, genuine, avg(ln(x + 1)) AS m, var_pop(ln(x + 1)) AS v FROM cues GROUP BY ALL)
 SELECT cue, exp(avg(m)) AS threshold, (max(m) FILTER (genuine) - max(m) FILTER (NOT genuine)) / sqrt(avg(v)) AS separation FROM l GROUP BY ALL""")
def cue_fit(spark, sf):
    x = F.log(F.col("x") + 1)
    g, t = F.when(F.col("genuine"), x), F.when(~F.col("genuine"), x)
    s = cues(spark, sf).groupBy("cue").agg(F.avg(g).alias("mg"), F.avg(t).alias("mt"), F.var_pop(g).alias("vg"), F.var_pop(t).alias("vt"))
    return s.select("cue", F.exp((F.col("mg") + F.col("mt")) / 2).alias("threshold"), ((F.col("mg") - F.col("mt")) / F.sqrt((F.col("vg") + F.col("vt")) / 2)).alias("separation"))


@query("attack_vs_owner", "attack:l n_gen:l n_imp:l eer:d auc:d frr_at_5:d frr_at_1:d", f"""WITH {Q.ATT}, {Q.TS}, o AS (SELECT s_voice FROM ts WHERE is_genuine),
 v AS (SELECT attack, false AS is_genuine, s_voice AS score FROM att UNION ALL SELECT k, true, s_voice FROM o, range(1, 8) r(k)), {Q.curve('v', 'attack')}, {Q.metrics('attack')},
 d AS (SELECT attack, score, row_number() OVER (PARTITION BY attack ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY attack) AS n FROM v WHERE NOT is_genuine),
 th AS (SELECT attack, max(score) FILTER (r = least(floor(0.05::DOUBLE * n), n - 1) + 1) AS t5, max(score) FILTER (r = least(floor(0.01::DOUBLE * n), n - 1) + 1) AS t1 FROM d GROUP BY ALL),
 fr AS (SELECT attack, avg((s_voice <= t5)::INT) AS frr_at_5, avg((s_voice <= t1)::INT) AS frr_at_1 FROM th CROSS JOIN o GROUP BY ALL)
 SELECT *, eer_nearest AS eer FROM (SELECT * EXCLUDE (eer) FROM mt) JOIN fr USING (attack)""")
def attack_vs_owner(spark, sf):
    """Attacks taken as the strangers: what blocking them costs the owner. Both sides enter as histograms."""
    own = views.trial_scores(spark, sf).filter("is_genuine").select(F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, 8)])).alias("attack"), F.lit(True).alias("is_genuine"), F.col("s_voice").alias("score"))
    att = views.attack_trials(spark, sf).select("attack", F.lit(False).alias("is_genuine"), F.col("s_voice").alias("score"))
    pts = C.curve(own.unionByName(att), ["attack"]).transform(hold)
    m = C.curve_metrics(pts, ["attack"], far_targets={"t5": 0.05, "t1": 0.01})
    cost = pts.join(F.broadcast(m.select("attack", "t5", "t1")), "attack").groupBy("attack").agg(*[
        (F.sum(F.when(F.col("t") <= F.col(t), F.col("n_gen")).otherwise(0)) / F.max("g")).alias(n) for t, n in (("t5", "frr_at_5"), ("t1", "frr_at_1"))])
    return m.withColumn("eer", F.col("eer_nearest")).join(cost, "attack")


@query("trend_fit", "n:l slope:d intercept:d r:d", f"""WITH {Q.TS}, s AS (SELECT probe_speaker, avg(s_voice) AS x, avg(s_know) AS y FROM ts GROUP BY ALL)
 SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r FROM s HAVING count(*) >= 5 AND var_pop(x) > 0 AND var_pop(y) > 0""")
def trend_fit(spark, sf):
    s = views.trial_scores(spark, sf).groupBy("probe_speaker").agg(F.avg("s_voice").alias("x"), F.avg("s_know").alias("y"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"),
                 F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).filter("n >= 5 and vx > 0 and vy > 0")


@query("enrollee_slices", "device region:l n:l frr:d mean:d low:d", f"""WITH {Q.TS} SELECT device, region, count(*) AS n, avg((s_voice < 0.62)::INT) AS frr, avg(s_voice) AS mean, min(s_voice) AS low
 FROM ts WHERE is_genuine GROUP BY ALL HAVING count(*) >= 5""")
def enrollee_slices(spark, sf):
    return views.trial_scores(spark, sf).filter("is_genuine").groupBy("device", "region").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("s_voice") < 0.62).cast("int")).alias("frr"), F.avg("s_voice").alias("mean"), F.min("s_voice").alias("low")).filter("n >= 5")


@query("cluster_bootstrap", "device n_clusters:l rate:d lo:d hi:d", f"""WITH {Q.TS}, c AS (SELECT device, probe_speaker, count(*) FILTER (s_voice < 0.5) AS k, count(*) AS n FROM ts WHERE is_genuine GROUP BY ALL),
 r AS (SELECT *, {I.sql_fine_weight(7, 'rep', 'device, probe_speaker')} AS w FROM c CROSS JOIN range(1, 1001) z(rep)),
 b AS (SELECT device, rep, sum(w * k) / nullif(sum(w * n), 0)::DOUBLE AS rate FROM r GROUP BY ALL)
 SELECT device, (SELECT count(*) FROM c WHERE c.device = b.device) AS n_clusters, (SELECT sum(k) / sum(n)::DOUBLE FROM c WHERE c.device = b.device) AS rate,
 quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi FROM b GROUP BY ALL""")
def cluster_bootstrap(spark, sf):
    return I.cluster_rate(rejected(spark, sf), ["device"], "probe_speaker", 1000, 7, I.fine_weights)


def rejected(spark, sf):
    """Rejections and trials of each speaker on each device, at a fixed threshold."""
    return views.trial_scores(spark, sf).filter("is_genuine").groupBy("device", "probe_speaker").agg(F.count_if(F.col("s_voice") < 0.5).alias("k"), F.count(F.lit(1)).alias("n"))


@query("reported_interval", "device k:l n:l n_clusters:l rate:d lo:d hi:d informative:b", f"""WITH {Q.TS}, c AS (SELECT device, probe_speaker, count(*) FILTER (s_voice < 0.5) AS k, count(*) AS n FROM ts WHERE is_genuine GROUP BY ALL),
 {I.sql_reported('ri', 'c', 'device', 'probe_speaker')} SELECT * FROM ri""")
def reported_interval(spark, sf):
    """The interval to print for each device's rejection rate."""
    return I.reported_interval(rejected(spark, sf), ["device"], "probe_speaker")


@query("eer_bootstrap", "config eer:d lo:d hi:d", f"WITH {Q.TS}, {Q.configs(CONF_W, P.veto)}, {Q.fused('ts')}, {I.sql_eer_interval('bi', 'fu', 'config')} SELECT * FROM bi")
def eer_bootstrap(spark, sf):
    """EER of every configuration with its interval over 1,000 replicates."""
    return I.eer_interval(scored(spark, sf), ["config"])


@query("yield_summary", "attack:l generated:l annotated:l admissible:l yield:d sources:l mean_similarity:d", f"""WITH {Q.ATT} SELECT attack, count(*) AS generated, count(integrity) AS annotated,
 count(*) FILTER (integrity IS NOT NULL AND admissible) AS admissible, count(*) FILTER (integrity IS NOT NULL AND admissible) / nullif(count(integrity), 0)::DOUBLE AS yield,
 count(DISTINCT speaker) AS sources, avg(s_voice) FILTER (integrity IS NOT NULL) AS mean_similarity FROM att GROUP BY ALL""")
def yield_summary(spark, sf):
    seen = F.col("integrity").isNotNull()
    return views.attack_trials(spark, sf).groupBy("attack").agg(
        F.count(F.lit(1)).alias("generated"), F.count("integrity").alias("annotated"), F.count_if(seen & F.col("admissible")).alias("admissible"),
        F.try_divide(F.count_if(seen & F.col("admissible")), F.count("integrity")).alias("yield"), F.count_distinct("speaker").alias("sources"), F.avg(F.when(seen, F.col("s_voice"))).alias("mean_similarity"))


@query("blockers", "rule blocked:b n:l", f"""WITH {Q.ATT}, {Q.TS} SELECT 'simulated' AS rule, count(*) FILTER (simulated) > 0 AS blocked, count(*) FILTER (simulated) AS n FROM att
 UNION ALL SELECT 'graph_coverage', count(s_graph) / count(*)::DOUBLE < 0.5, count(*) - count(s_graph) FROM ts UNION ALL SELECT 'knowledge_coverage', count(s_know) / count(*)::DOUBLE < 0.5, count(*) - count(s_know) FROM ts
 UNION ALL SELECT 'gold_set', count(*) FILTER (q IS NOT NULL) / count(*)::DOUBLE < 0.6, count(*) FILTER (q IS NULL) FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS q FROM labels) USING (doc_id)
 UNION ALL SELECT 'within_session', (SELECT count(*) FROM (SELECT probe_speaker FROM ts GROUP BY 1 HAVING count(DISTINCT date_trunc('month', ts."at")) < 2)) > 0, (SELECT count(*) FROM (SELECT probe_speaker FROM ts GROUP BY 1 HAVING count(DISTINCT date_trunc('month', ts."at")) < 2))""")
def blockers(spark, sf):
    """Reasons a run may not be reported, each a one-row check."""
    sim = views.attack_trials(spark, sf).agg(F.count_if("simulated").alias("n")).select(F.lit("simulated").alias("rule"), (F.col("n") > 0).alias("blocked"), "n")
    ts = views.trial_scores(spark, sf)
    cov = ts.agg(F.count(F.lit(1)).alias("all"), F.count("s_graph").alias("g"), F.count("s_know").alias("k")).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), (F.col(c) / F.col("all") < 0.5).alias("blocked"), (F.col("all") - F.col(c)).alias("n")) for name, c in (("graph_coverage", "g"), ("knowledge_coverage", "k"))])))
    covered = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("q")).distinct()
    gold = table(spark, sf, "documents").select("doc_id").join(covered, "doc_id", "left").agg(F.count("*").alias("all"), F.count("q").alias("k")).select(
        F.lit("gold_set").alias("rule"), (F.col("k") / F.col("all") < 0.6).alias("blocked"), (F.col("all") - F.col("k")).alias("n"))
    cov = cov.unionByName(gold)
    one = ts.groupBy("probe_speaker").agg(F.count_distinct(F.date_trunc("month", "at")).alias("m")).agg(F.count_if(F.col("m") < 2).alias("n"))
    return sim.unionByName(cov).unionByName(one.select(F.lit("within_session").alias("rule"), (F.col("n") > 0).alias("blocked"), "n"))
