"""Nested evaluation protocols over unit vectors: every threshold is fitted without the sitting and the strangers it is applied to.

For an enrollee and a held-out sitting (the fold), templates of the remaining
sittings but one more (the inner one) score that inner sitting and the fit
strangers: these are dev trials, and they alone fix the fold's thresholds. The
template of all remaining sittings scores the held-out sitting and the test
strangers. "All but two sittings" is the total minus two sums, so the vectors
are aggregated once for every fold and inner sitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.functions.vector import dot, minus, unit
from verilens.operators import curves as C
from verilens.operators import intervals as I
from verilens.operators import vectors as V
from verilens.operators.pairs import each_with_each
from verilens.operators.scan import exact_quantiles, rank_by_digest
from verilens.sources.held import settled
from verilens.sources.tables import small_side

#: Variants in their registered order. Fixed values.
VARIANTS = ("baseline", "meansub", "asnorm", "meansub_asnorm", "trimmed")
#: Rule names and the false-accept rates that they aim at; ``eer`` aims at equal rates. Fixed values.
FAR_RULES = {"far0.01": 0.01, "far0.001": 0.001}
#: A false-accept target is resolvable if dev holds so many expected events.
MIN_EVENTS = 5
TEMPLATE = ["claimed", "fold", "inner"]


def roles(speakers: DataFrame, stratum: str, unit_col: str, seed: int = 7, enrol: float = 0.2, share: float = 0.25, min_size: int = 5) -> DataFrame:
    """(stratum, unit, role): enrollee, norm, fit or test by seeded digest rank in each stratum; a small stratum is test."""
    placed = speakers.select(stratum, unit_col).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(unit_col).cast("string"))))
    r = rank_by_digest(placed, [stratum], "_h", [unit_col], "rn", "n")
    own = F.greatest(F.lit(1), F.bround(F.col("n") * enrol, 0))
    cut = F.greatest(F.lit(1), F.bround((F.col("n") - own) * share, 0))
    role = (
        F.when(F.col("n") < min_size, "test").when(F.col("rn") <= own, "enrollee").when(F.col("rn") <= own + cut, "norm")
        .when(F.col("rn") <= own + 2 * cut, "fit").otherwise("test"))
    return r.select(stratum, unit_col, role.alias("role"))


def in_roles(units: DataFrame, r: DataFrame) -> DataFrame:
    """``units`` with ``role`` and ``source``; ``r`` has a row a speaker."""
    small = small_side(r.select(F.col("unit").alias("speaker"), F.col("stratum").alias("source"), "role"), sized_by=units.select("speaker").distinct())
    return units.join(small, "speaker")


def pair_sums(units: DataFrame) -> DataFrame:
    """(claimed, fold, inner, s): the sum of each speaker's vectors outside both sittings; inner = fold leaves out one sitting."""
    per = V.group_sums(units, ["speaker", "session"])
    total = per.groupBy("speaker").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("_all"), F.sum("n").alias("_n"))
    a = per.select("speaker", F.col("session").alias("fold"), F.col("s").alias("_sa"), F.col("n").alias("_na"))
    b = per.select("speaker", F.col("session").alias("inner"), F.col("s").alias("_sb"), F.col("n").alias("_nb"))
    same = F.col("fold") == F.col("inner")
    rest = minus(F.col("_all"), F.col("_sa"))
    rest = F.when(same, rest).otherwise(minus(rest, F.col("_sb")))
    left = F.col("_n") - F.col("_na") - F.when(same, 0).otherwise(F.col("_nb"))
    return a.join(b, "speaker").join(total, "speaker").filter(left > 0).select(F.col("speaker").alias("claimed"), "fold", "inner", rest.alias("s"))


def templates(units: DataFrame) -> DataFrame:
    """(claimed, fold, inner, c) for the vectors of enrollees."""
    return pair_sums(units).select(*TEMPLATE, unit(F.col("s")).alias("c")).filter(F.col("c").isNotNull())


def trimmed(units: DataFrame, given: DataFrame, trim: float = 0.2) -> DataFrame:
    """``given`` templates averaged anew without the share of enrolment vectors furthest from them. Only enrollees' vectors are met, once a template of their own."""
    outside = (F.col("session") != F.col("fold")) & (F.col("session") != F.col("inner"))
    own = units.join(given, (F.col("speaker") == F.col("claimed")) & outside).select(*TEMPLATE, "v", dot(F.col("v"), F.col("c")).alias("own")).transform(settled)
    cut = exact_quantiles(own, TEMPLATE, "own", {"cut": trim})
    kept = own.join(cut, TEMPLATE).filter(F.col("own") >= F.col("cut") - 1e-12)
    return V.centroids(kept, TEMPLATE).select(*TEMPLATE, "c")


def _listed(scored: DataFrame, genuine: bool, part) -> DataFrame:
    return scored.select(*TEMPLATE, part.alias("part"), "vec_id", F.col("speaker").alias("probe_speaker"), "source", "session", F.lit(genuine).alias("is_genuine"), "score")


def trials(units: DataFrame, given: DataFrame) -> DataFrame:
    """Dev and test trials of ``units`` (with role and source) against ``given`` templates.

    Owners meet their own templates by (speaker, sitting), an equi-join.
    Strangers meet every template of their part: the trial list of a protocol,
    by the tiles of ``each_scored``.
    """
    owner = units.filter("role = 'enrollee'").join(given, (F.col("speaker") == F.col("claimed")) & (F.col("session") == F.col("inner")))
    outer = F.col("fold") == F.col("inner")
    part = F.when(outer, "test").otherwise("dev")
    out = _listed(owner.withColumn("score", dot(F.col("v"), F.col("c"))), True, part)
    for role, of in (("fit", ~outer), ("test", outer)):
        out = out.unionByName(_listed(V.each_scored(units.filter(F.col("role") == role), given.filter(of), TEMPLATE, ["vec_id"]), False, part))
    return out


def normed(t: DataFrame, given: DataFrame, probes: DataFrame, cohort: DataFrame, k: int, probe_key: Sequence[str] = ("vec_id",)) -> DataFrame:
    """``t`` with scores normalised against the nearest cohort vectors of the template and of the probe."""
    of = V.top_k_stats(given, cohort, TEMPLATE, k, "c").select(*TEMPLATE, F.col("mu").alias("_mt"), F.col("sd").alias("_st"))
    own = V.top_k_stats(probes, cohort, list(probe_key), k, "v").select(*probe_key, F.col("mu").alias("_mp"), F.col("sd").alias("_sp"))
    s = F.col("score")
    z = ((s - F.col("_mt")) / F.col("_st") + (s - F.col("_mp")) / F.col("_sp")) / 2
    return t.join(of, TEMPLATE).join(own, list(probe_key)).withColumn("score", z).drop("_mt", "_st", "_mp", "_sp")


def cohort_size(cohort: DataFrame, top: int = 100) -> int:
    """How many nearest cohort vectors count: half of them, 2 at least and ``top`` at most."""
    return max(2, min(top, cohort.limit(2 * top).count() // 2))


def variant_trials(units: DataFrame) -> DataFrame:
    """Dev and test trials of every variant in one table; ``units`` have role and source."""
    cohort = units.filter("role = 'norm'")
    k = cohort_size(cohort)
    keep = ["variant", "ord", *TEMPLATE, "part", "vec_id", "probe_speaker", "source", "session", "is_genuine", "score"]
    moved = V.mean_subtracted(units, cohort).transform(settled)
    out = None

    def add(name: str, t: DataFrame) -> None:
        nonlocal out
        t = t.select(F.lit(name).alias("variant"), F.lit(VARIANTS.index(name)).alias("ord"), *keep[2:])
        out = t if out is None else out.unionByName(t)

    for backend, plain, norm in ((units, "baseline", "asnorm"), (moved, "meansub", "meansub_asnorm")):
        owners = backend.filter("role = 'enrollee'")
        given = templates(owners).transform(settled)
        t = trials(backend, given).transform(settled)  # read twice
        add(plain, t)
        add(norm, normed(t, given, backend.filter("role <> 'norm'"), backend.filter("role = 'norm'"), k))
        if plain == "baseline":
            add("trimmed", trials(backend, trimmed(owners, given).transform(settled)))
    return settled(out)


def thresholds(dev: DataFrame, groups: Sequence[str], rules: Mapping[str, float] = FAR_RULES) -> DataFrame:
    """(groups, rule, threshold, strict, n_dev): fitted on dev trials alone. A rate rule accepts strictly above its order statistic."""
    m = C.metrics(dev, list(groups), far_targets={f"_{i}": t for i, t in enumerate(rules.values())})
    rows = [F.struct(F.lit("eer").alias("rule"), F.col("thr_eer").alias("threshold"), F.lit(False).alias("strict"), F.lit(None).cast("double").alias("target"))]
    rows += [F.struct(F.lit(r).alias("rule"), F.col(f"_{i}").alias("threshold"), F.lit(True).alias("strict"), F.lit(t).alias("target")) for i, (r, t) in enumerate(rules.items())]
    return m.select(*groups, F.col("n_imp").alias("n_dev"), F.inline(F.array(*rows)))


def applied(test: DataFrame, fitted: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Test trials with every rule of their fold and whether it accepts them."""
    above = F.when(F.col("strict"), F.col("score") > F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))
    # a row a group and rule, counted and then joined
    return test.join(small_side(fitted.transform(settled)), list(groups)).withColumn("accepted", above)


def operating_points(decided: DataFrame, groups: Sequence[str], genuine_cluster: str, impostor_cluster: str, folds: int | None = None) -> DataFrame:
    """(groups, rule, counts, rates, reported intervals, informative, resolvable) of decided test trials.

    Clusters of genuine trials are sittings or enrollees, those of impostor
    trials are speakers or enrollees. A rate is resolvable if the dev trials
    of a fold hold enough expected events.
    """
    g = F.col("is_genuine")
    by = [*groups, "rule"]
    flags = decided.select(*by, g.alias("_g"), F.when(g, F.col(genuine_cluster).cast("string")).otherwise(F.col(impostor_cluster).cast("string")).alias("cluster"), (g != F.col("accepted")).cast("int").alias("wrong"))
    cells = flags.groupBy(*by, "_g", "cluster").agg(F.sum("wrong").alias("k"), F.count("*").alias("n")).transform(settled)

    def side(genuine: bool, names: dict[str, str]) -> DataFrame:
        r = I.reported_interval(cells.filter(F.col("_g") == genuine).drop("_g"), by, "cluster")
        return r.select(*by, *[F.col(a).alias(b) for a, b in names.items()])

    frr = side(True, {"k": "false_rejects", "n": "n_gen", "rate": "frr", "lo": "frr_lo", "hi": "frr_hi", "informative": "frr_informative"})
    far = side(False, {"k": "false_accepts", "n": "n_imp", "rate": "far", "lo": "far_lo", "hi": "far_hi", "informative": "far_informative"})
    dev = decided.groupBy(*by).agg(F.min((F.col("target").isNull() | (F.col("n_dev") * F.col("target") >= MIN_EVENTS)).cast("int")).alias("r"))
    return frr.join(far, by).join(dev.select(*by, (F.col("r") == 1).alias("resolvable")), by)


def attacks(strangers: DataFrame, given: DataFrame) -> DataFrame:
    """(attack, vec_id, probe_speaker, claimed, fold, v): attack probes aimed at each fold's template, a stranger's own vector and one moved half the way to the target."""
    outer = given.filter(F.col("fold") == F.col("inner"))
    pairs = each_with_each(strangers, outer, outer, TEMPLATE, ["vec_id"])
    moved = unit(F.zip_with("v", "c", lambda x, y: x + y))
    kinds = F.array(F.struct(F.lit("stranger").alias("attack"), F.col("v").alias("_v")), F.struct(F.lit("blend").alias("attack"), moved.alias("_v")))
    return pairs.select("vec_id", F.col("speaker").alias("probe_speaker"), "claimed", "fold", F.inline(kinds)).withColumnRenamed("_v", "v").filter("v IS NOT NULL")


def attacks_normed(t: DataFrame, given: DataFrame, probes: DataFrame, cohort: DataFrame, k: int) -> DataFrame:
    """``normed`` for attack trials. A stranger's own vector is the same whatever template it is aimed at, so it meets the cohort once."""
    own = [F.col("attack") == "stranger", F.col("attack") != "stranger"]
    once = probes.filter(own[0]).groupBy("vec_id").agg(F.first("v").alias("v"))
    out = normed(t.filter(own[0]), given, once, cohort, k)
    return out.unionByName(normed(t.filter(own[1]), given, probes.filter(own[1]), cohort, k, ["attack", "vec_id", "claimed", "fold"]))


def attack_trials(units: DataFrame) -> DataFrame:
    """(variant, attack, claimed, fold, vec_id, score): every attack probe against the template it is aimed at, in every variant."""
    cohort = units.filter("role = 'norm'").transform(settled)
    k = cohort_size(cohort)
    owners, key = units.filter("role = 'enrollee'"), ["attack", "vec_id", "claimed", "fold"]
    given = templates(owners).transform(settled)
    plain = attacks(units.filter("role = 'test'"), given).transform(settled)
    moved_owners = V.mean_subtracted(owners, cohort)
    moved = V.mean_subtracted(plain, cohort).transform(settled)
    out = None
    for probes, of, co, name, norm in (
            (plain, given, cohort, "baseline", "asnorm"), (moved, templates(moved_owners).transform(settled), V.mean_subtracted(cohort, cohort), "meansub", "meansub_asnorm"),
            (plain, trimmed(owners, given).transform(settled), None, "trimmed", None)):
        outer = of.filter(F.col("fold") == F.col("inner"))
        t = probes.join(small_side(outer), ["claimed", "fold"]).select(*key, "inner", dot(F.col("v"), F.col("c")).alias("score"))
        for n, x in [(name, t)] + ([(norm, attacks_normed(t, outer, probes, co, k))] if norm else []):
            x = x.select(F.lit(n).alias("variant"), *key, "score")
            out = x if out is None else out.unionByName(x)
    return settled(out)


def population(units: DataFrame, seed: int = 7, norm_share: float = 0.2) -> DataFrame:
    """``units`` (with source) with ``role``: norm, dev or test by seeded digest rank in each source, the rest halved."""
    placed = units.select("source", "speaker").distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("speaker").cast("string"))))
    r = rank_by_digest(placed, ["source"], "_h", ["speaker"], "rn", "n")
    n_norm = F.greatest(F.lit(1), F.bround(F.col("n") * norm_share, 0))
    n_dev = F.floor((F.col("n") - n_norm) / 2)
    role = F.when(F.col("rn") <= n_norm, "norm").when(F.col("rn") <= n_norm + n_dev, "dev").otherwise("test")
    return units.join(small_side(r.select("speaker", role.alias("role")), sized_by=placed), "speaker")


def population_trials(units: DataFrame) -> DataFrame:
    """Trials of every variant of the population protocol: enrollees of a part against its other speakers."""
    cohort = units.filter("role = 'norm'")
    k = cohort_size(cohort)
    moved = V.mean_subtracted(units, cohort).transform(settled)
    out = None
    for backend, plain, norm in ((units, "baseline", "asnorm"), (moved, "meansub", "meansub_asnorm")):
        part = backend.filter("role <> 'norm'")
        whole = templates(part).filter(F.col("fold") == F.col("inner")).transform(settled)
        of = small_side(part.select(F.col("speaker").alias("claimed"), F.col("role").alias("_role")).distinct())
        for name, given in [(plain, whole)] + ([("trimmed", trimmed(part, whole).transform(settled))] if plain == "baseline" else []):
            t = None
            for role in ("dev", "test"):
                models = given.join(of, "claimed").filter(F.col("_role") == role).drop("_role")
                pairs = V.each_scored(part.filter(F.col("role") == role), models, TEMPLATE, ["vec_id"])
                pairs = pairs.filter((F.col("speaker") != F.col("claimed")) | (F.col("session") == F.col("fold"))).select(
                    *TEMPLATE, F.col("role").alias("part"), "vec_id", F.col("speaker").alias("probe_speaker"), "source", "session",
                    (F.col("speaker") == F.col("claimed")).alias("is_genuine"), "score")
                t = pairs if t is None else t.unionByName(pairs)
            t = t.transform(settled) if name == plain else t  # read twice
            named = [(name, t)] + ([(norm, normed(t, given, part, backend.filter("role = 'norm'"), k))] if name == plain else [])
            for n, x in named:
                x = x.select(F.lit(n).alias("variant"), F.lit(VARIANTS.index(n)).alias("ord"), *t.columns)
                out = x if out is None else out.unionByName(x)
    return settled(out)
