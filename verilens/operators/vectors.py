"""Centroids, held-out templates and scores over unit vectors.

Sums per group use ``Summarizer`` (a JVM aggregate with partial sums), so the
vector column is never exploded and a hot speaker is combined on the map side.
"Every session but this one" is total minus own, not a re-aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from verilens.functions.arrays import compute_once, let
from verilens.functions.vector import dot, minus, norm, unit
from verilens.operators.pairs import each_with_each
from verilens.sources.held import hold

#: Items and cohort vectors of a tile of a search, at most about; scores of a tile that are in memory at once.
TILE_ITEMS, TILE_COHORT, TILE_SCORES = 16_384, 65_536, 1 << 22
#: Probes of a tile of trials at most, about; trials of a tile.
TILE_PROBES, TILE_TRIALS = 16_384, 1 << 20


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Replace ``v`` by its unit vector; invalid vectors become NULL and are dropped."""
    rest = [c for c in vectors.columns if c != "v"]
    return compute_once(vectors, rest, v=unit(F.col("v"))).filter(F.col("v").isNotNull())


def group_sums(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, s, n): vector sum and count of each group."""
    return units.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("s"), F.count(F.lit(1)).alias("n")
    )


def centroids(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, c): renormalised mean of unit vectors."""
    return group_sums(units, keys).select(*keys, "n", unit(F.col("s")).alias("c"))


def holdout_sums(units: DataFrame) -> DataFrame:
    """(speaker, session, s, n, rest, n_rest): own-session sum and the sum of the speaker's other sessions."""
    per = group_sums(units, ["speaker", "session"])
    total = per.groupBy("speaker").agg(
        vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("all_s"), F.sum("n").alias("all_n")
    )
    return per.join(total, "speaker").select(
        "speaker", "session", "s", "n",
        minus(F.col("all_s"), F.col("s")).alias("rest"), (F.col("all_n") - F.col("n")).alias("n_rest"),
    )


def holdout_templates(units: DataFrame) -> DataFrame:
    """(claimed, fold, c, n_enrol): template of each speaker without session ``fold``."""
    return (
        holdout_sums(units)
        .filter("n_rest > 0")
        .select(F.col("speaker").alias("claimed"), F.col("session").alias("fold"), unit(F.col("rest")).alias("c"),
                F.col("n_rest").alias("n_enrol"))
        .filter(F.col("c").isNotNull())
    )


def _tile_of_trials(few_names: Sequence[str]):
    """Function of a tile: each of its probes (``v``) with each of its models (``c``), the score in place of the vectors, NULL without one. It needs nothing of this package in the worker."""
    import pyarrow as pa

    def tile(probes: pa.Table, models: pa.Table) -> pa.Table:
        n, m = probes.num_rows, models.num_rows
        scores, known = np.zeros((m, n)), [t[name].is_valid().to_numpy() for t, name in ((probes, "v"), (models, "c"))]
        if known[0].any() and known[1].any():
            x, c = (t[name].drop_null().combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(have.sum(), -1) for t, name, have in ((probes, "v", known[0]), (models, "c", known[1])))
            for i, v in zip(np.flatnonzero(known[1]), c, strict=True):
                scores[i, known[0]] = np.einsum("ij,j->i", x, v)  # row by row, so that equal vectors get equal scores
        out = probes.drop_columns(["v", "_r", "_c"]).take(pa.array(np.tile(np.arange(n), m)))
        for name in few_names:
            out = out.append_column(name, models[name].take(pa.array(np.repeat(np.arange(m), n))))
        return out.append_column("score", pa.array(scores.reshape(-1), mask=~np.outer(known[1], known[0]).reshape(-1)))

    return tile


def each_scored(many: DataFrame, few: DataFrame, few_key: Sequence[str], many_key: Sequence[str]) -> DataFrame:
    """Every row of ``many`` (with ``v``) and every row of ``few`` (with ``c``), ``score`` in place of the vectors.

    The trial list of ``each_with_each``, a tile of probes and models at a time:
    a vector enters a tile once, not once a pair.
    """
    n_many, n_few = many.count(), few.count()
    columns = max(-(-n_few // 1024), 1)
    wide = max(-(-n_few // columns), 1)
    cores = many.sparkSession.sparkContext.defaultParallelism
    rows = max(-(-n_many // min(TILE_PROBES, max(TILE_TRIALS // wide, 1))), min(2 * cores, -(-n_many // 1024)), 1)
    left = many.withColumn("_r", F.pmod(F.xxhash64(*many_key), F.lit(rows))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = few.withColumn("_c", F.pmod(F.xxhash64(*few_key), F.lit(columns)).cast("int")).withColumn("_r", F.explode(F.expr(f"sequence(0L, {rows - 1}L)")))
    names = [c for c in few.columns if c != "c"]
    out = StructType([f for f in many.schema if f.name != "v"] + [few.schema[c] for c in names] + [StructField("score", DoubleType())])
    return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(_tile_of_trials(names), out)


def holdout_trials(units: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Probe of a session against its speaker's template without that session; impostors against every fold."""
    probes = units if probes is None else probes
    pairs = each_scored(probes, holdout_templates(units).select("claimed", "fold", "c"), ["claimed", "fold"], ["vec_id"])
    return pairs.filter((F.col("speaker") != F.col("claimed")) | (F.col("session") == F.col("fold"))).select(
        "vec_id", F.col("speaker").alias("probe_speaker"), "session", "claimed", "fold",
        (F.col("speaker") == F.col("claimed")).alias("is_genuine"), "score")


def centroid_trials(units: DataFrame) -> DataFrame:
    """Every vector against every speaker's whole centroid."""
    models = centroids(units, ["speaker"]).select(F.col("speaker").alias("claimed"), "c")
    pairs = each_with_each(units, models, units.select("speaker").distinct(), ["claimed"], ["vec_id"])
    return pairs.select(
        "vec_id", F.col("speaker").alias("probe_speaker"), "session", "claimed",
        (F.col("speaker") == F.col("claimed")).alias("is_genuine"), dot(F.col("v"), F.col("c")).alias("score"),
    )


def self_consistency(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean pairwise cosine in O(n d): (|sum|^2 - n) / (n (n - 1)); 1 for a single vector."""
    s = group_sums(units, keys)
    n = F.col("n")
    return s.select(
        *keys, "n",
        F.when(n < 2, F.lit(1.0)).otherwise((dot(F.col("s"), F.col("s")) - n) / (n * (n - 1))).alias("consistency"),
    )


def own_rest_cosine(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each vector's cosine to the centroid of the *other* vectors of its group, without a pairwise join."""
    sums = group_sums(units, keys)
    own = let(minus(F.col("s"), F.col("v")), lambda rest: dot(rest, F.col("v")) / norm(rest))
    return units.join(sums, list(keys)).select(*units.columns, "n", F.when(F.col("n") > 1, own).alias("own"))


def mean_subtracted(units: DataFrame, norm_units: DataFrame) -> DataFrame:
    """Unit vectors with the norm cohort's mean taken out, renormalised. The mean is one row."""
    mu = norm_units.agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("_mu"))
    moved = units.join(F.broadcast(mu))
    return compute_once(moved, [c for c in units.columns if c != "v"], v=unit(minus(F.col("v"), F.col("_mu"))))


def _best(k: int, key: Sequence[str], vec: str):
    """Function of a tile: the k best cohort scores of each of its items; none for an item without a vector. It needs nothing of this package in the worker."""
    import pyarrow as pa

    budget = TILE_SCORES

    def matrix(lists) -> np.ndarray:
        # Zero rows make up a multiple of 64: every product then comes from the same kernel, and equal vectors get equal scores.
        x = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        return np.pad(x, ((0, -len(x) % 64), (0, 0)))

    def tile(items: pa.Table, cohort: pa.Table) -> pa.Table:
        if cohort.num_rows == 0:
            items = items.slice(0, 0)
        known, vectors = items.filter(items[vec].is_valid()), cohort["_cv"].drop_null()
        take = min(k, len(vectors))
        top = np.empty((len(known), take))
        if len(known) and take:
            x, m = matrix(known[vec]), matrix(vectors).T.copy()
            step = max(64, budget // m.shape[1] // 64 * 64)
            for at in range(0, len(x), step):
                s = (x[at:at + step] @ m)[:len(known) - at, :len(vectors)]
                s.partition(len(vectors) - take, axis=1)
                top[at:at + step] = s[:, len(vectors) - take:]  # a slice that is kept would keep all scores of the tile
        ends = np.cumsum(np.where(items[vec].is_valid().to_numpy(), take, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(top.reshape(-1)))
        return items.select(list(key)).append_column("_top", lists)

    return tile


def top_k_stats(items: DataFrame, cohort: DataFrame, key: Sequence[str], k: int, vec: str) -> DataFrame:
    """Mean and deviation (ddof 0, plus 1e-6) of each item's k best cohort scores.

    Every item meets every cohort vector, a tile of both at a time: a task holds
    one tile, multiplies it as matrices and gives k scores an item; the best of
    an item's tiles are merged by key. No row is made for a pair.
    """
    n_items, n_cohort = items.count(), cohort.count()
    cores = items.sparkSession.sparkContext.defaultParallelism
    rows = max(-(-n_items // TILE_ITEMS), min(2 * cores, -(-n_items // 1024)), 1)
    columns = max(-(-n_cohort // TILE_COHORT), 1)
    left = items.select(*key, vec, F.pmod(F.xxhash64(*key), F.lit(rows)).alias("_r")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = cohort.select(F.col("v").alias("_cv"), F.pmod(F.xxhash64("vec_id"), F.lit(columns)).cast("int").alias("_c")).withColumn("_r", F.explode(F.expr(f"sequence(0L, {rows - 1}L)")))
    out = StructType([items.schema[c] for c in key] + [StructField("_top", ArrayType(DoubleType()))])
    tops = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(_best(k, key, vec), out)
    merged = compute_once(tops.groupBy(*key).agg(F.flatten(F.collect_list("_top")).alias("_t")), list(key), _t=F.slice(F.sort_array("_t", asc=False), 1, k))
    total = lambda of: F.aggregate("_t", F.lit(0.0), lambda s, x: s + of(x))
    n = F.nullif(F.size("_t"), F.lit(0))
    mean = compute_once(merged, [*key, "_t"], mu=total(lambda x: x) / n)
    return mean.select(*key, "mu", (F.sqrt(total(lambda x: (x - F.col("mu")) * (x - F.col("mu"))) / n) + 1e-6).alias("sd"))


def adaptive_norm(trials: DataFrame, templates: DataFrame, probes: DataFrame, cohort: DataFrame, k: int) -> DataFrame:
    """Average of the z-scores against the template's and the probe's nearest cohort vectors."""
    t = top_k_stats(templates, cohort, ["claimed", "fold"], k, "c").select("claimed", "fold", F.col("mu").alias("_mt"), F.col("sd").alias("_st"))
    p = top_k_stats(probes, cohort, ["vec_id"], k, "v").select("vec_id", F.col("mu").alias("_mp"), F.col("sd").alias("_sp"))
    s = F.col("score")
    z = ((s - F.col("_mt")) / F.col("_st") + (s - F.col("_mp")) / F.col("_sp")) / 2
    return trials.join(t, ["claimed", "fold"]).join(p, "vec_id").withColumn("score", z).drop("_mt", "_st", "_mp", "_sp")


def trimmed_templates(units: DataFrame, trim: float = 0.2) -> DataFrame:
    """Held-out templates re-averaged without the share of enrolment vectors farthest from the centroid."""
    from verilens.operators.scan import exact_quantiles
    from verilens.sources.tables import small_side

    size = units.select("speaker", "session").distinct()
    t = small_side(holdout_templates(units), 20_000, size)
    own = units.join(t, (F.col("speaker") == F.col("claimed")) & (F.col("session") != F.col("fold"))).select(
        "claimed", "fold", "v", dot(F.col("v"), F.col("c")).alias("own")).transform(hold)
    cut = exact_quantiles(own, ["claimed", "fold"], "own", {"cut": trim})
    kept = own.join(small_side(cut, 20_000, size), ["claimed", "fold"]).filter(F.col("own") >= F.col("cut"))
    return centroids(kept, ["claimed", "fold"]).select("claimed", "fold", "c")


def trials_against(probes: DataFrame, templates: DataFrame, sized_by: DataFrame) -> DataFrame:
    """Held-out trials against given (claimed, fold, c) templates."""
    pairs = each_with_each(probes, templates, sized_by, ["claimed", "fold"], ["vec_id"])
    return pairs.filter((F.col("speaker") != F.col("claimed")) | (F.col("session") == F.col("fold"))).select(
        "vec_id", F.col("speaker").alias("probe_speaker"), "session", "claimed", "fold",
        (F.col("speaker") == F.col("claimed")).alias("is_genuine"), dot(F.col("v"), F.col("c")).alias("score"))


def sitting_matrix(units: DataFrame) -> DataFrame:
    """(speaker, probe session, template session, mean cosine); the diagonal leaves the probe out of its own template."""
    s = group_sums(units, ["speaker", "session"]).select("speaker", F.col("session").alias("template"), "s", "n")
    j = units.join(s, "speaker")
    same = F.col("session") == F.col("template")
    rest = F.when(same, minus(F.col("s"), F.col("v"))).otherwise(F.col("s"))
    cos = let(rest, lambda r: dot(r, F.col("v")) / norm(r))
    return j.withColumn("_x", F.when(~same | (F.col("n") > 1), cos)).groupBy("speaker", F.col("session").alias("probe"), "template").agg(F.avg("_x").alias("mean"))


def nearest_remembered(units: DataFrame, memory_size: int, threshold: float) -> DataFrame:
    """Best remembered vector of each vector at or above the threshold. The memory of an arrival is the ``memory_size`` items before it.

    Arrivals are numbered by id. A block of ``memory_size`` of them meets itself
    and the block before, so that a task holds two blocks however many there are.
    """
    from verilens.operators.scan import rank_within

    cells = units.select("vec_id", "v", F.lit(0).alias("_all"), F.floor(F.col("vec_id") / 4096).alias("_b"))
    placed = rank_within(cells, ["_all"], "_b", ["vec_id"], "pos").select("vec_id", "v", "pos").withColumn("block", F.floor((F.col("pos") - 1) / memory_size)).transform(hold)
    memory = placed.select(F.col("vec_id").alias("mid"), F.col("v").alias("mv"), F.col("pos").alias("mpos"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    s = placed.join(memory, "block").filter((F.col("mpos") < F.col("pos")) & (F.col("mpos") >= F.col("pos") - memory_size)).select("vec_id", "mid", dot(F.col("v"), F.col("mv")).alias("sim"))
    best = s.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("mid")).alias("m"))).alias("b"))
    return best.select("vec_id", (-F.col("b.m")).alias("match"), F.col("b.sim").alias("sim")).filter(F.col("sim") >= threshold)
