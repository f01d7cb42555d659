"""Nested single-enrollee, population and enrollee protocols over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilens.functions.stats import wilson
from verilens.operators import curves as C
from verilens.operators import intervals as I
from verilens.operators import nested as N
from verilens.operators import vectors as V
from verilens.plans import sqlviews as Q
from verilens.plans.registry import query
from verilens.plans.vectors import units
from verilens.sources.held import hold, settled

#: Threshold that stands for the system's own in the enrollee evaluation.
SYSTEM = 0.05


def sourced(spark, sf):
    """Unit vectors with a source; speakers of even and odd number come from two of them."""
    return units(spark, sf).withColumn("source", F.col("speaker") % 2)


def in_roles(spark, sf):
    u = sourced(spark, sf)
    return settled(N.in_roles(u.drop("source"), N.roles(u, "source", "speaker").toDF("stratum", "unit", "role")))


# ------------------------------------------------------------------- SQL text

def _mean_of(keys: str, rows: str) -> str:
    """SELECT of (keys, c): the unit mean of exploded vectors."""
    return f"SELECT {keys}, {Q.unit('c')} AS c FROM (SELECT {keys}, list(x ORDER BY d) AS c FROM (SELECT {keys}, d, avg(x) AS x FROM ({rows}) GROUP BY ALL) GROUP BY ALL)"


def _moved(src: str, out: str, rest: str, mu: str = "mu") -> str:
    """CTE: ``src`` (rest, v) with the norm cohort's mean taken out."""
    return f"{out} AS (SELECT {rest}, {Q.unit('m')} AS v FROM (SELECT {rest}, [p[1] - p[2] FOR p IN list_zip(v, m0)] AS m FROM {src}, {mu}))"


def _mean(src: str, out: str = "mu") -> str:
    return f"{out} AS (SELECT list(x ORDER BY d) AS m0 FROM (SELECT d, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {src} WHERE role = 'norm') GROUP BY d))"


def _top(out: str, rows: str, key: str, vec: str, cohort: str) -> str:
    """CTE: mean and deviation of the best cohort scores of each row."""
    return f"""{out} AS (SELECT {key}, avg(s) AS m, stddev_pop(s) + 1e-6 AS sd FROM (SELECT {key}, s, row_number() OVER (PARTITION BY {key} ORDER BY s DESC) AS r
  FROM (SELECT {", ".join("x." + k.strip() for k in key.split(","))}, list_dot_product(x.{vec}, co.v) AS s FROM {rows} x CROSS JOIN (SELECT v FROM {cohort} WHERE role = 'norm') co)), kk WHERE r <= kk.k GROUP BY ALL)"""


_KEY = "claimed, fold, inn"
_ROLES = f"""{Q.VEC}, rk AS (SELECT k, k % 2 AS src, row_number() OVER (PARTITION BY k % 2 ORDER BY md5('7|' || k), k) AS r, count(*) OVER (PARTITION BY k % 2) AS n FROM (SELECT DISTINCT speaker AS k FROM uv)),
 re AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS e FROM rk), rc AS (SELECT *, greatest(1, round_even((n - e) * 0.25::DOUBLE, 0)) AS c FROM re),
 ru AS (SELECT vec_id, speaker, session, src, CASE WHEN n < 5 THEN 'test' WHEN r <= e THEN 'enrollee' WHEN r <= e + c THEN 'norm' WHEN r <= e + 2 * c THEN 'fit' ELSE 'test' END AS role, v
  FROM uv JOIN rc ON k = speaker), {_mean('ru')}, {_moved('ru', 'rm', 'vec_id, speaker, session, src, role')},
 kk AS (SELECT greatest(2, least(100, count(*) // 2)) AS k FROM ru WHERE role = 'norm')"""


def _templates(p: str, u: str) -> str:
    """CTEs: templates ``{p}t`` of enrollees without two sittings."""
    return f"""{p}d AS (SELECT speaker, session, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {u} WHERE role = 'enrollee'), {p}w AS (SELECT DISTINCT speaker, session FROM {p}d),
 {p}t AS ({_mean_of(_KEY, f"SELECT f.speaker AS claimed, fold, inn, d, x FROM (SELECT a.speaker, a.session AS fold, b.session AS inn FROM {p}w a JOIN {p}w b USING (speaker)) f JOIN {p}d e ON e.speaker = f.speaker AND e.session <> fold AND e.session <> inn")})"""


def _trials(out: str, t: str, u: str) -> str:
    return f"""{out} AS (SELECT {_KEY}, CASE WHEN fold = inn THEN 'test' ELSE 'dev' END AS part, vec_id, speaker AS probe_speaker, src, session, speaker = claimed AS is_genuine, list_dot_product(v, c) AS score
  FROM {t} JOIN {u} ON (speaker = claimed AND session = inn) OR (role = 'fit' AND fold <> inn) OR (role = 'test' AND fold = inn))"""


def _normed(out: str, t: str, of: str, own: str, key: str = "vec_id") -> str:
    return f"{out} AS (SELECT s.* REPLACE (((score - a.m) / a.sd + (score - b.m) / b.sd) / 2 AS score) FROM {t} s JOIN {of} a USING ({_KEY}) JOIN {own} b USING ({key}))"


def _trimmed(t: str, u: str) -> str:
    return f"""tw AS (SELECT {_KEY}, v, list_dot_product(v, c) AS own FROM {u} JOIN {t} ON speaker = claimed AND session <> fold AND session <> inn), tc AS (SELECT {_KEY}, quantile_cont(own, 0.2) AS cut FROM tw GROUP BY ALL),
 t2 AS ({_mean_of(_KEY, f"SELECT {_KEY}, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM tw JOIN tc USING ({_KEY}) WHERE own >= cut - 1e-12")})"""


def _union(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS variant, {N.VARIANTS.index(v)} AS ord, * FROM {t}" for v, t in parts.items())


_BOTH = f"{_ROLES}, {_templates('b', 'ru')}, {_templates('m', 'rm')}, {_trimmed('bt', 'ru')}, {_top('btt', 'bt', _KEY, 'c', 'ru')}, {_top('mtt', 'mt', _KEY, 'c', 'rm')}"
_NEST = f"""{_BOTH}, {_trials('bs', 'bt', 'ru')}, {_trials('ms', 'mt', 'rm')}, {_trials('ts2', 't2', 'ru')}, {_top('bpt', 'ru', 'vec_id', 'v', 'ru')}, {_top('mpt', 'rm', 'vec_id', 'v', 'rm')},
 {_normed('bz', 'bs', 'btt', 'bpt')}, {_normed('mz', 'ms', 'mtt', 'mpt')},
 vt AS ({_union({'baseline': 'bs', 'meansub': 'ms', 'asnorm': 'bz', 'meansub_asnorm': 'mz', 'trimmed': 'ts2'})}), vd AS (SELECT * FROM vt WHERE part = 'dev'), ve AS (SELECT * FROM vt WHERE part = 'test')"""


def _thresholds(dev: str, groups: str) -> str:
    """CTE ``th``: thresholds of every rule from dev trials."""
    rates = " UNION ALL ".join(f"SELECT {groups}, '{r}', score, true, {t!r}::DOUBLE, n FROM ko WHERE r = least(floor({t!r}::DOUBLE * n), n - 1) + 1" for r, t in N.FAR_RULES.items())
    return f"""{Q.curve(dev, groups, 'dc')}, {Q.metrics(groups, 'dc', 'dm')}, ko AS (SELECT {groups}, score, row_number() OVER (PARTITION BY {groups} ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY {groups}) AS n FROM {dev} WHERE NOT is_genuine),
 th({groups}, rule, threshold, strict, target, n_dev) AS (SELECT {groups}, 'eer', thr_eer, false, NULL::DOUBLE, n_imp FROM dm UNION ALL {rates})"""


_AP = f"""{_NEST}, {_thresholds('vd', 'variant, claimed, fold')},
 ap AS (SELECT e.*, rule, target, n_dev, CASE WHEN strict THEN score > threshold ELSE score >= threshold END AS acc FROM ve e JOIN th USING (variant, claimed, fold))"""


def _points(groups: str, gen: str, imp: str) -> str:
    """CTEs and SELECT of the operating points of ``ap``."""
    keys = f"{groups}, rule"
    return f"""og AS (SELECT {keys}, {gen} AS cluster, count(*) FILTER (NOT acc) AS k, count(*) AS n FROM ap WHERE is_genuine GROUP BY ALL), oi AS (SELECT {keys}, {imp} AS cluster, count(*) FILTER (acc) AS k, count(*) AS n FROM ap WHERE NOT is_genuine GROUP BY ALL),
 {I.sql_reported('fr', 'og', keys, 'cluster')}, {I.sql_reported('fa', 'oi', keys, 'cluster')}, dn AS (SELECT {keys}, bool_and(target IS NULL OR n_dev * target >= {N.MIN_EVENTS}) AS resolvable FROM ap GROUP BY ALL)
 SELECT {keys}, r.k AS false_rejects, r.n AS n_gen, r.rate AS frr, r.lo AS frr_lo, r.hi AS frr_hi, r.informative AS frr_informative, a.k AS false_accepts, a.n AS n_imp, a.rate AS far, a.lo AS far_lo, a.hi AS far_hi,
 a.informative AS far_informative, resolvable FROM fr r JOIN fa a USING ({keys}) JOIN dn USING ({keys})"""


_POINT_COLS = "rule false_rejects:l n_gen:l frr:d frr_lo:d frr_hi:d frr_informative:b false_accepts:l n_imp:l far:d far_lo:d far_hi:d far_informative:b resolvable:b"


# -------------------------------------------------------------- single enrollee

FOLD = ["variant", "claimed", "fold"]


def nested_trials(spark, sf):
    return N.variant_trials(in_roles(spark, sf))


def decided(spark, sf):
    t = nested_trials(spark, sf)
    return N.applied(t.filter("part = 'test'"), N.thresholds(t.filter("part = 'dev'"), FOLD), FOLD).transform(hold)


@query("split_roles", "source:l speaker:l role n:l", f"WITH {_ROLES} SELECT src AS source, speaker, role, count(*) AS n FROM ru GROUP BY ALL")
def split_roles(spark, sf):
    """Enrollees and the strangers' norm, fit and test parts, with their vectors."""
    return in_roles(spark, sf).groupBy("source", "speaker", "role").agg(F.count("*").alias("n"))


@query("variant_select", "claimed:l variant dev_eer:d ties:l", f"""WITH {_NEST}, {Q.curve('vd', 'variant, claimed', 'dc')}, {Q.metrics('variant, claimed', 'dc', 'dm')}, o AS (SELECT DISTINCT variant, ord FROM vt)
 SELECT claimed, variant, eer AS dev_eer, (SELECT count(*) FROM dm x WHERE x.claimed = dm.claimed AND abs(x.eer - dm.eer) < 1e-12) AS ties FROM dm JOIN o USING (variant)
 QUALIFY row_number() OVER (PARTITION BY claimed ORDER BY round(eer, 9), ord) = 1""")
def variant_select(spark, sf):
    """Each enrollee's variant of lowest dev EER, ties by registered order."""
    dev = C.metrics(nested_trials(spark, sf).filter("part = 'dev'"), ["variant", "ord", "claimed"])
    best = dev.groupBy("claimed").agg(F.min(F.struct(F.round("eer", 9).alias("r"), "ord", "variant", "eer")).alias("b"), F.collect_list("eer").alias("all"))  # a row per variant
    return best.select("claimed", "b.variant", F.col("b.eer").alias("dev_eer"), F.size(F.filter("all", lambda e: F.abs(e - F.col("b.eer")) < 1e-12)).alias("ties"))


@query("poc_protocol", "claimed:l variant n_gen:l n_imp:l dev_eer:d eer:d min_dcf:d auc:d gap:d delta_eer:d delta_min_dcf:d better:b", f"""WITH {_NEST}, {Q.curve('vd', 'variant, claimed', 'dc')}, {Q.metrics('variant, claimed', 'dc', 'dm')},
 {Q.curve('ve', 'variant, claimed', 'qc')}, {Q.metrics('variant, claimed', 'qc', 'tm')}
 SELECT t.claimed, t.variant, t.n_gen, t.n_imp, d.eer AS dev_eer, t.eer, t.min_dcf, t.auc, t.gen_min - t.imp_max AS gap, t.eer - b.eer AS delta_eer, t.min_dcf - b.min_dcf AS delta_min_dcf, t.eer < b.eer AND t.min_dcf < b.min_dcf AS better
 FROM tm t JOIN dm d ON d.variant = t.variant AND d.claimed = t.claimed JOIN tm b ON b.claimed = t.claimed AND b.variant = 'baseline'""")
def poc_protocol(spark, sf):
    """Nested leave-one-sitting-out protocol of each enrollee: dev EER, test metrics, and the change against the baseline."""
    t = nested_trials(spark, sf)
    m = C.metrics(t, ["part", "variant", "claimed"]).transform(hold)
    dev = m.filter("part = 'dev'").select("variant", "claimed", F.col("eer").alias("dev_eer"))
    test = m.filter("part = 'test'").drop("part")
    b = test.filter("variant = 'baseline'").select("claimed", F.col("eer").alias("_e"), F.col("min_dcf").alias("_d"))
    return test.join(dev, ["variant", "claimed"]).join(b, "claimed").withColumn("gap", F.col("gen_min") - F.col("imp_max")).withColumn("delta_eer", F.col("eer") - F.col("_e")).withColumn(
        "delta_min_dcf", F.col("min_dcf") - F.col("_d")).withColumn("better", (F.col("eer") < F.col("_e")) & (F.col("min_dcf") < F.col("_d")))


@query("fold_thresholds", "variant claimed:l fold:l rule threshold:d n_dev:l", f"WITH {_NEST}, {_thresholds('vd', 'variant, claimed, fold')} SELECT variant, claimed, fold, rule, threshold, n_dev FROM th")
def fold_thresholds(spark, sf):
    """Thresholds of every rule and fold, from dev trials alone."""
    return N.thresholds(nested_trials(spark, sf).filter("part = 'dev'"), FOLD)


@query("operating_points", f"variant claimed:l {_POINT_COLS}", f"WITH {_AP}, {_points('variant, claimed', 'session', 'probe_speaker')}")
def operating_points(spark, sf):
    """Each fold's thresholds applied unchanged to its test trials, with the intervals to print."""
    return N.operating_points(decided(spark, sf), ["variant", "claimed"], "session", "probe_speaker")


@query("points_by_sitting", "variant claimed:l fold:l rule n:l mean:d low:d frr:d", f"WITH {_AP} SELECT variant, claimed, fold, rule, count(*) AS n, avg(score) AS mean, min(score) AS low, avg((NOT acc)::INT) AS frr FROM ap WHERE is_genuine GROUP BY ALL")
def points_by_sitting(spark, sf):
    """Owner scores and rejections of each held-out sitting."""
    return decided(spark, sf).filter("is_genuine").groupBy("variant", "claimed", "fold", "rule").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.avg((~F.col("accepted")).cast("int")).alias("frr"))


@query("points_by_source", "variant claimed:l source:l rule speakers:l trials:l mean:d top:d far:d", f"""WITH {_AP} SELECT variant, claimed, src AS source, rule, count(DISTINCT probe_speaker) AS speakers, count(*) AS trials, avg(score) AS mean, max(score) AS top, avg(acc::INT) AS far
 FROM ap WHERE NOT is_genuine GROUP BY ALL""")
def points_by_source(spark, sf):
    """Test strangers of each source: scores and false accepts."""
    return decided(spark, sf).filter("not is_genuine").groupBy("variant", "claimed", "source", "rule").agg(
        F.count_distinct("probe_speaker").alias("speakers"), F.count("*").alias("trials"), F.avg("score").alias("mean"), F.max("score").alias("top"), F.avg(F.col("accepted").cast("int")).alias("far"))


_AKEY = "attack, vec_id, claimed, fold"
_ATTACK = f"""{_NEST}, {_thresholds('vd', 'variant, claimed, fold')}, a0 AS (SELECT vec_id, claimed, fold, v, [p[1] + p[2] FOR p IN list_zip(v, c)] AS w FROM ru JOIN bt ON role = 'test' AND fold = inn),
 aa AS (SELECT 'stranger' AS attack, vec_id, claimed, fold, v FROM a0 UNION ALL SELECT 'blend', vec_id, claimed, fold, {Q.unit('w')} FROM a0), {_moved('aa', 'am', _AKEY)},
 ab AS (SELECT aa.attack, aa.vec_id, claimed, fold, inn, list_dot_product(v, c) AS score FROM aa JOIN bt USING (claimed, fold) WHERE inn = fold), amm AS (SELECT am.attack, am.vec_id, claimed, fold, inn, list_dot_product(v, c) AS score FROM am JOIN mt USING (claimed, fold) WHERE inn = fold),
 atr AS (SELECT aa.attack, aa.vec_id, claimed, fold, inn, list_dot_product(v, c) AS score FROM aa JOIN t2 USING (claimed, fold) WHERE inn = fold), {_top('apt', 'aa', _AKEY, 'v', 'ru')}, {_top('ampt', 'am', _AKEY, 'v', 'rm')},
 abz AS (SELECT s.* REPLACE (((score - a.m) / a.sd + (score - b.m) / b.sd) / 2 AS score) FROM ab s JOIN btt a USING ({_KEY}) JOIN apt b USING ({_AKEY})), amz AS (SELECT s.* REPLACE (((score - a.m) / a.sd + (score - b.m) / b.sd) / 2 AS score) FROM amm s JOIN mtt a USING ({_KEY}) JOIN ampt b USING ({_AKEY})),
 av AS ({_union({'baseline': 'ab', 'meansub': 'amm', 'asnorm': 'abz', 'meansub_asnorm': 'amz', 'trimmed': 'atr'})})"""


@query("attack_report", "attack variant claimed:l rule n:l accepted:l rate:d lo:d hi:d mean:d top:d", f"""WITH {_ATTACK}, g AS (SELECT attack, variant, claimed, rule, count(*) AS n, count(*) FILTER (CASE WHEN strict THEN score > threshold ELSE score >= threshold END) AS accepted, avg(score) AS mean, max(score) AS top
  FROM av JOIN th USING (variant, claimed, fold) GROUP BY ALL) SELECT *, accepted / n::DOUBLE AS rate, {Q.wilson('accepted', 'n')[0]} AS lo, {Q.wilson('accepted', 'n')[1]} AS hi FROM g""")
def attack_report(spark, sf):
    """Attack probes aimed at each fold's template under that fold's dev thresholds, by attack, variant and rule."""
    u = in_roles(spark, sf)
    fitted = N.thresholds(N.variant_trials(u).filter("part = 'dev'"), FOLD)
    lo, hi = wilson(F.col("accepted"), F.col("n"))
    return N.applied(N.attack_trials(u), fitted, FOLD).groupBy("attack", "variant", "claimed", "rule").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.avg("score").alias("mean"), F.max("score").alias("top")).withColumn("rate", F.col("accepted") / F.col("n")).withColumn("lo", lo).withColumn("hi", hi)


@query("attack_folds", "attack variant claimed:l fold:l n:l mean:d", f"WITH {_ATTACK} SELECT attack, variant, claimed, fold, count(*) AS n, avg(score) AS mean FROM av GROUP BY ALL")
def attack_folds(spark, sf):
    """Mean attack score of each fold."""
    return N.attack_trials(in_roles(spark, sf)).groupBy("attack", "variant", "claimed", "fold").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


# ------------------------------------------------------------------ enrollee

_ENR = f"""{_ROLES}, {_templates('b', 'ru')}, el AS (SELECT speaker AS claimed, max(session) AS last FROM ru WHERE role = 'enrollee' GROUP BY 1), es AS (SELECT claimed, last, max(session) AS before FROM el JOIN ru ON speaker = claimed AND session < last GROUP BY ALL),
 ef AS (SELECT t.claimed, c, last, before, inn = last AS whole FROM bt t JOIN es USING (claimed) WHERE fold = last AND inn IN (last, before)),
 et AS (SELECT claimed, whole, speaker AS probe_speaker, session, role = 'test' AS held, speaker = claimed AS is_genuine, list_dot_product(v, c) AS score FROM ef JOIN ru ON (speaker = claimed AND session = CASE WHEN whole THEN last ELSE before END) OR role IN ('norm', 'fit') OR (role = 'test' AND whole)),
 ed AS (SELECT * FROM et WHERE NOT whole), {Q.curve('ed', 'claimed', 'ec')}, {Q.metrics('claimed', 'ec', 'em')}"""


def enrollee_scores(spark, sf):
    """Owner and stranger scores against the template without the last sitting, and dev scores without the last two."""
    u = in_roles(spark, sf)
    owners = u.filter("role = 'enrollee'")
    last = owners.groupBy(F.col("speaker").alias("claimed")).agg(F.max("session").alias("last"))
    before = owners.join(last, (F.col("speaker") == F.col("claimed")) & (F.col("session") < F.col("last"))).groupBy("claimed", "last").agg(F.max("session").alias("before"))
    given = N.templates(owners).join(before, "claimed").filter((F.col("fold") == F.col("last")) & F.col("inner").isin(F.col("last"), F.col("before")))
    given = given.select("claimed", "c", "last", "before", (F.col("inner") == F.col("last")).alias("whole")).transform(settled)
    held_out = F.when(F.col("whole"), F.col("last")).otherwise(F.col("before"))
    own = u.join(given, (F.col("speaker") == F.col("claimed")) & (F.col("session") == held_out))
    others = N.each_with_each(u.filter("role <> 'enrollee'"), given, given, ["claimed", "whole"], ["vec_id"]).filter((F.col("role") != "test") | F.col("whole"))
    keep = ["claimed", "whole", F.col("speaker").alias("probe_speaker"), "session", (F.col("role") == "test").alias("held"), (F.col("speaker") == F.col("claimed")).alias("is_genuine"), N.dot(F.col("v"), F.col("c")).alias("score")]
    return settled(own.select(*keep).unionByName(others.select(*keep)))


def _wrong(kind: str, genuine: bool, at: str, held: bool) -> tuple[str, str, str]:
    where = "whole AND " + ("is_genuine" if genuine else "NOT is_genuine") + (" AND held" if held else "")
    return kind, where, f"score < {at}" if genuine else f"score >= {at}"


_KINDS = [_wrong("frr", True, str(SYSTEM), False), _wrong("far", False, str(SYSTEM), False), _wrong("fitted_frr", True, "thr_eer", False), _wrong("fitted_far", False, "thr_eer", True)]
_ENR_CELLS = " UNION ALL ".join(f"SELECT claimed, '{kind}' AS kind, CASE WHEN is_genuine THEN session ELSE probe_speaker END AS cluster, count(*) FILTER ({wrong}) AS k, count(*) AS n FROM et JOIN em USING (claimed) WHERE {where} GROUP BY ALL" for kind, where, wrong in _KINDS)


@query("enrollee_eval", "claimed:l kind k:l n:l n_clusters:l rate:d lo:d hi:d informative:b threshold:d", f"""WITH {_ENR}, cl AS ({_ENR_CELLS}), {I.sql_reported('ri', 'cl', 'claimed, kind', 'cluster')}
 SELECT ri.*, CASE WHEN kind IN ('frr', 'far') THEN {SYSTEM} ELSE thr_eer END AS threshold FROM ri JOIN em USING (claimed)""")
def enrollee_eval(spark, sf):
    """Held-out rates of each enrollee at the system threshold and at one fitted on an earlier sitting and other strangers."""
    s = enrollee_scores(spark, sf)
    fitted = C.metrics(s.filter("NOT whole"), ["claimed"]).select("claimed", "thr_eer").transform(hold)
    t = s.join(fitted, "claimed")
    rows = [F.when(F.expr(where), F.struct(F.lit(kind).alias("kind"), F.expr(wrong).cast("int").alias("wrong"))) for kind, where, wrong in _KINDS]
    cells = t.select("claimed", F.when(F.col("is_genuine"), F.col("session")).otherwise(F.col("probe_speaker")).alias("cluster"), F.inline(F.array_compact(F.array(*rows))))
    cells = cells.groupBy("claimed", "kind", "cluster").agg(F.sum("wrong").alias("k"), F.count("*").alias("n"))
    return I.reported_interval(cells, ["claimed", "kind"], "cluster").join(fitted, "claimed").withColumn("threshold", F.when(F.col("kind").isin("frr", "far"), SYSTEM).otherwise(F.col("thr_eer")))


@query("enrollee_stats", "claimed:l n_gen:l n_imp:l gen_mean:d gen_min:d imp_mean:d imp_max:d d_prime:d gap:d", f"""WITH {_ENR} SELECT claimed, count(*) FILTER (is_genuine) AS n_gen, count(*) FILTER (NOT is_genuine) AS n_imp, avg(score) FILTER (is_genuine) AS gen_mean, min(score) FILTER (is_genuine) AS gen_min,
 avg(score) FILTER (NOT is_genuine) AS imp_mean, max(score) FILTER (NOT is_genuine) AS imp_max, min(score) FILTER (is_genuine) - max(score) FILTER (NOT is_genuine) AS gap,
 (avg(score) FILTER (is_genuine) - avg(score) FILTER (NOT is_genuine)) / sqrt((var_samp(score) FILTER (is_genuine) + var_samp(score) FILTER (NOT is_genuine)) / 2) AS d_prime FROM et WHERE whole GROUP BY ALL""")
def enrollee_stats(spark, sf):
    """Separation of each enrollee's held-out scores from all strangers'."""
    t = enrollee_scores(spark, sf).filter("whole").transform(hold)
    g, i = F.when(F.col("is_genuine"), F.col("score")), F.when(~F.col("is_genuine"), F.col("score"))
    m = t.groupBy("claimed").agg(F.avg(g).alias("gen_mean"), F.min(g).alias("gen_min"), F.avg(i).alias("imp_mean"), F.max(i).alias("imp_max"), F.count(g).alias("n_gen"), F.count(i).alias("n_imp"))
    return m.join(C.d_prime(t, ["claimed"]).select("claimed", "d_prime"), "claimed").withColumn("gap", F.col("gen_min") - F.col("imp_max"))


@query("impostor_slices", "claimed:l probe_speaker:l n:l mean:d top:d far:d", f"WITH {_ENR} SELECT claimed, probe_speaker, count(*) AS n, avg(score) AS mean, max(score) AS top, avg((score >= {SYSTEM})::INT) AS far FROM et WHERE whole AND NOT is_genuine GROUP BY ALL")
def impostor_slices(spark, sf):
    """Each stranger against each enrollee: the impostor half of the enrollee slices."""
    return enrollee_scores(spark, sf).filter("whole AND NOT is_genuine").groupBy("claimed", "probe_speaker").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("top"), F.avg((F.col("score") >= SYSTEM).cast("int")).alias("far"))


# ----------------------------------------------------------------- population

_POP = f"""{Q.VEC}, rk AS (SELECT k, k % 2 AS src, row_number() OVER (PARTITION BY k % 2 ORDER BY md5('7|' || k), k) AS r, count(*) OVER (PARTITION BY k % 2) AS n FROM (SELECT DISTINCT speaker AS k FROM uv)),
 rn AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS m FROM rk),
 ru AS (SELECT vec_id, speaker, session, src, CASE WHEN r <= m THEN 'norm' WHEN r <= m + floor((n - m) / 2) THEN 'dev' ELSE 'test' END AS role, v FROM uv JOIN rn ON k = speaker), {_mean('ru')}, {_moved('ru', 'rm', 'vec_id, speaker, session, src, role')},
 kk AS (SELECT greatest(2, least(100, count(*) // 2)) AS k FROM ru WHERE role = 'norm')"""


def _whole(p: str, u: str) -> str:
    return f"""{p}d AS (SELECT speaker, session, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {u} WHERE role <> 'norm'),
 {p}t AS ({_mean_of(_KEY, f"SELECT f.speaker AS claimed, f.session AS fold, f.session AS inn, d, x FROM (SELECT DISTINCT speaker, session FROM {p}d) f JOIN {p}d e ON e.speaker = f.speaker AND e.session <> f.session")})"""


def _within(out: str, t: str, u: str) -> str:
    return f"""{out} AS (SELECT {_KEY}, u.role AS part, u.vec_id, u.speaker AS probe_speaker, u.src, u.session, u.speaker = claimed AS is_genuine, list_dot_product(v, c) AS score
  FROM {t} JOIN (SELECT DISTINCT speaker AS s, role AS s_role FROM {u}) w ON s = claimed JOIN {u} u ON u.role = s_role AND (u.speaker <> claimed OR u.session = fold))"""


_POP_T = f"""{_POP}, {_whole('b', 'ru')}, {_whole('m', 'rm')}, {_trimmed('bt', "(SELECT * FROM ru WHERE role <> 'norm')")}, {_within('bs', 'bt', 'ru')}, {_within('ms', 'mt', 'rm')}, {_within('ts2', 't2', 'ru')},
 {_top('btt', 'bt', _KEY, 'c', 'ru')}, {_top('mtt', 'mt', _KEY, 'c', 'rm')}, {_top('bpt', 'ru', 'vec_id', 'v', 'ru')}, {_top('mpt', 'rm', 'vec_id', 'v', 'rm')}, {_normed('bz', 'bs', 'btt', 'bpt')}, {_normed('mz', 'ms', 'mtt', 'mpt')},
 vt AS ({_union({'baseline': 'bs', 'meansub': 'ms', 'asnorm': 'bz', 'meansub_asnorm': 'mz', 'trimmed': 'ts2'})}), vd AS (SELECT * FROM vt WHERE part = 'dev'), ve AS (SELECT * FROM vt WHERE part = 'test')"""


def population(spark, sf):
    return N.population_trials(settled(N.population(sourced(spark, sf))))


@query("population_protocol", "variant part n_gen:l n_imp:l eer:d min_dcf:d auc:d gen_min:d imp_max:d", f"WITH {_POP_T}, {Q.curve('vt', 'variant, part')}, {Q.metrics('variant, part', 'cv', 'pm')} SELECT * FROM pm")
def population_protocol(spark, sf):
    """Many enrollees, parts split by speaker in each source; impostors are the part's other speakers."""
    return C.metrics(population(spark, sf), ["variant", "part"])


@query("population_points", f"variant {_POINT_COLS}", f"""WITH {_POP_T}, {_thresholds('vd', 'variant')}, ap AS (SELECT e.*, rule, target, n_dev, CASE WHEN strict THEN score > threshold ELSE score >= threshold END AS acc FROM ve e JOIN th USING (variant)),
 {_points('variant', 'claimed', 'claimed')}""")
def population_points(spark, sf):
    """One threshold a variant and rule, fitted on the dev enrollees and applied unchanged to the test enrollees."""
    t = population(spark, sf)
    d = N.applied(t.filter("part = 'test'"), N.thresholds(t.filter("part = 'dev'"), ["variant"]), ["variant"]).transform(hold)
    return N.operating_points(d, ["variant"], "claimed", "claimed")
