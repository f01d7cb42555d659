"""Score fusion: weighted means over measured branches, vetoes, gates and policy fitting.

A policy or configuration is a few literals (or columns of a config row exploded
onto each trial), so one pass over the trials evaluates every variant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.sources.held import hold

BRANCHES = ("voice", "graph", "know")
VETOED = float("-inf")


@dataclass(frozen=True)
class Policy:
    """Weights add up to 1; the veto floor lies under the threshold (None turns it off)."""

    voice: float = 0.40
    graph: float = 0.30
    know: float = 0.30
    threshold: float = 0.55
    margin: float = 0.05
    veto: float | None = 0.35
    integrity_floor: float = 0.25
    voice_gate: bool = False
    voice_threshold: float = 0.62
    grey_margin: float = 0.08
    phrase_threshold: float = 0.6
    require_knowledge: bool = False
    know_threshold: float = 0.7

    def __post_init__(self) -> None:
        if abs(self.voice + self.graph + self.know - 1) > 1e-6:
            raise ValueError("fusion weights must add up to 1")
        if self.veto is not None and self.veto >= self.threshold:
            raise ValueError("veto floor must be under the threshold")


CONFIGURATIONS = {
    "voice alone": (1, 0, 0), "graph alone": (0, 1, 0), "voice + knowledge": (1, 0, 1), "voice + graph": (1, 1, 0),
    "full": (1, 1, 1),
}
ATTACK_CONFIGURATIONS = {k: CONFIGURATIONS[k] for k in ("voice alone", "voice + knowledge", "voice + graph", "full")}


def configs(weights: dict[str, Sequence[float]], veto: dict[str, float | None] | float | None) -> Column:
    """Array of config structs (config, ord, w_voice, w_graph, w_know, veto), to be inlined onto each trial."""
    rows = []
    for i, (name, w) in enumerate(weights.items()):
        v = veto.get(name) if isinstance(veto, dict) else veto
        rows.append(F.struct(
            F.lit(name).alias("config"), F.lit(i).alias("ord"),
            *[F.lit(float(x)).alias(f"w_{b}") for b, x in zip(BRANCHES, w)], F.lit(v).cast("double").alias("veto"),
        ))
    return F.array(*rows)


def weighted(policy: Policy, table: dict[str, Sequence[int]]) -> dict[str, tuple[float, ...]]:
    """Policy weights restricted to each configuration's branches and renormalised (uniform when all are zero)."""
    out = {}
    for name, on in table.items():
        w = [getattr(policy, b) * x for b, x in zip(BRANCHES, on)]
        total = sum(w)
        out[name] = tuple(x / total for x in w) if total else tuple(x / sum(on) for x in on)
    return out


def fused_parts() -> tuple[Column, Column]:
    """(weighted mean over measured branches or NULL, graph veto fired) from w_*, s_* and veto columns."""
    num = den = None
    for b in BRANCHES:
        s, w = F.col(f"s_{b}"), F.col(f"w_{b}")
        on = F.when(s.isNotNull(), w).otherwise(F.lit(0.0))
        part = on * F.coalesce(s, F.lit(0.0))
        num, den = (part, on) if num is None else (num + part, den + on)
    veto = F.coalesce((F.col("w_graph") > 0) & (F.col("s_graph") < F.col("veto")), F.lit(False))
    return F.when(den > 0, num / den), veto


def fuse(trials: DataFrame) -> DataFrame:
    """Add ``score``: fused score, -Infinity when vetoed or nothing was measured."""
    mean, veto = fused_parts()
    return trials.withColumn("score", F.when(veto | mean.isNull(), F.lit(VETOED)).otherwise(mean))


def decide(trials: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Add fused, decision and reason. Gates come in order: liveness, integrity, phrase, voice; then fusion, then veto.

    Reads s_*, w_*, veto, liveness_ok, integrity (NULL = not run) and, when present, phrase (NULL = not asked).
    """
    mean, veto = fused_parts()
    live = ~F.coalesce("liveness_ok", F.lit(True))
    tampered = F.coalesce(F.col("integrity") < p.integrity_floor, F.lit(False))
    phrase = F.coalesce(F.col("phrase") < p.phrase_threshold, F.lit(False)) if "phrase" in trials.columns else F.lit(False)
    v = F.col("s_voice")
    no_voice = v.isNull() if p.voice_gate else F.lit(False)
    low_voice = F.coalesce(v < p.voice_threshold - p.grey_margin, F.lit(False)) if p.voice_gate else F.lit(False)
    grey = F.coalesce(v < p.voice_threshold, F.lit(False)) if p.voice_gate else F.lit(False)
    on = sum((F.when(F.col(f"s_{b}").isNotNull(), F.col(f"w_{b}")).otherwise(0.0) for b in BRANCHES[1:]),
             F.when(v.isNotNull(), F.col("w_voice")).otherwise(0.0))
    effective = F.when(grey, F.col("fused") + F.col("w_voice") / on * (p.voice_threshold - v)).otherwise(F.col("fused"))
    near = F.abs(F.col("_eff") - p.threshold) <= p.margin if p.margin > 0 else F.lit(False)
    reaches = F.col("_eff") >= p.threshold - F.when(grey, F.lit(1e-9)).otherwise(F.lit(0.0))
    unknown = F.coalesce(F.col("s_know") < p.know_threshold, F.lit(False)) if p.require_knowledge else F.lit(False)
    reason = (
        F.when(live, "liveness").when(tampered, "integrity").when(phrase, "phrase").when(no_voice, "voice_missing")
        .when(low_voice, "voice").when(mean.isNull(), "unmeasured").when(veto, "veto").when(unknown, "knowledge")
        .when(near, "near").when(reaches & grey, "grey").when(reaches, "reached").otherwise("below")
    )
    gated = live | tampered | phrase | no_voice | low_voice | mean.isNull()
    out = trials.withColumn("fused", F.coalesce(mean, F.lit(0.0))).withColumn("_eff", effective).withColumn("reason", reason)
    return out.withColumn("fused", F.when(gated, F.lit(0.0)).otherwise(F.col("fused"))).withColumn(
        "decision", F.when(F.col("reason") == "reached", "ACCEPT").when(F.col("reason").isin("near", "grey"), "BORDERLINE").otherwise("REJECT")
    ).drop("_eff")


def veto_sweep(dev: DataFrame, threshold: Column, grid: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Per floor: false accepts removed and genuine rejects added by a graph veto at that floor.

    A trial accepted without a veto is lost to every floor above its graph score,
    so each trial adds to one grid slot and the sweep is a suffix sum over the grid.
    """
    floors = F.array(*[F.lit(float(f)) for f in grid])
    acc = (F.col("score") >= threshold) & F.col("s_graph").isNotNull()
    slot = F.size(F.filter(floors, lambda f: f <= F.col("s_graph")))
    per = dev.withColumn("slot", F.when(acc, slot)).groupBy(*keys, "slot").agg(
        F.count_if("is_genuine").alias("g"), F.count_if(~F.col("is_genuine")).alias("i")
    )
    packed = per.groupBy(*keys).agg(F.collect_list(F.struct("slot", "g", "i")).alias("cells"), F.sum("g").alias("ng"), F.sum("i").alias("ni"))

    def lost(field):  # accepted trials whose graph score lies under floor number k
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(c["slot"] < F.col("k"), c[field]).otherwise(F.lit(0)))

    return packed.select("*", F.posexplode(floors).alias("_k", "floor")).withColumn("k", F.col("_k") + 1).select(
        *keys, "floor", (lost("i") / F.col("ni")).alias("far_removed"), (lost("g") / F.col("ng")).alias("frr_cost")
    )


def veto_fit(sweep: DataFrame, threshold: Column, budget: float = 0.02, keys: Sequence[str] = ()) -> DataFrame:
    """Highest floor under the threshold that removes false accepts within the reject budget; NULL when none does."""
    ok = (F.col("floor") < threshold) & (F.col("frr_cost") <= budget) & (F.col("far_removed") > 0)
    best = F.max(F.when(ok, F.struct("floor", "far_removed", "frr_cost"))).alias("b")
    out = sweep.groupBy(*keys).agg(best) if keys else sweep.agg(best)
    return out.select(
        *keys, F.col("b.floor").alias("floor"), F.coalesce("b.far_removed", F.lit(0.0)).alias("far_removed"),
        F.coalesce("b.frr_cost", F.lit(0.0)).alias("frr_cost"),
    )


def _filled(dev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x0, x1, x2, y, n, w): distinct mean-imputed score rows of each group with their number and class weight."""
    cols = [f"s_{b}" for b in BRANCHES]
    y = F.col("is_genuine").cast("int")
    known = dev.select(*keys, *cols, y.alias("y"))
    about = known.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)], F.sum("y").alias("_g"), F.count("*").alias("_n"))
    cells = known.groupBy(*keys, *cols, "y").agg(F.count("*").alias("n"))
    joined = cells.join(F.broadcast(about), list(keys)) if keys else cells.crossJoin(F.broadcast(about))  # a row per group
    balance = F.col("_n") / (2.0 * F.when(F.col("y") == 1, F.col("_g")).otherwise(F.col("_n") - F.col("_g")))
    return joined.select(*keys, *[F.coalesce(c, f"_m{i}").alias(f"x{i}") for i, c in enumerate(cols)], "y", "n", balance.alias("w"))


def _slopes(cells: DataFrame, at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the gradient (g0..g3) and Hessian (h00..h33) of the weighted log loss at (b, c0, c1, c2), in one aggregate."""
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(BRANCHES))]]
    joined = cells.join(F.broadcast(at), list(keys)) if keys else cells.crossJoin(F.broadcast(at))  # a row per group
    score = F.col("b") + sum(F.col(f"c{i}") * F.col(f"x{i}") for i in range(len(BRANCHES)))
    joined = joined.withColumn("_p", 1 / (1 + F.exp(-score))).withColumn("_w", F.col("w") * F.col("n"))
    r, s = F.col("_w") * (F.col("_p") - F.col("y")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
    sums = [F.sum(r * x[i]).alias(f"g{i}") for i in range(len(x))]
    sums += [F.sum(s * x[i] * x[j]).alias(f"h{i}{j}") for i in range(len(x)) for j in range(i, len(x))]
    return joined.groupBy(*keys).agg(*sums)


def fit_weights(dev: DataFrame, keys: Sequence[str] = (), steps: int = 12, ridge: float = 1.0) -> DataFrame:
    """(keys, branch, weight, coef, gradient): class-balanced logistic regression on mean-imputed scores of every group at once.

    Newton's method from zero: a step is one aggregate over the distinct score
    rows of all groups and a 4 x 4 system a group on the driver. The intercept
    has no penalty. Negative coefficients are clipped, then normalised;
    ``gradient`` is the penalised one at the fitted coefficients. A group
    without trials of both kinds has no fit and no row.
    """
    import numpy as np

    keys = list(keys)
    spark, k = dev.sparkSession, len(BRANCHES)
    cells = _filled(dev, keys).transform(hold)
    names = ["b", *[f"c{i}" for i in range(k)]]
    both = cells.groupBy(*keys).agg(F.count_distinct("y").alias("_y")).filter("_y = 2").select(*keys, *[F.lit(0.0).alias(n) for n in names])
    schema = both.schema
    at = {tuple(r[c] for c in keys): np.zeros(k + 1) for r in both.collect()}  # a row per group
    grad = {}
    for _ in range(steps + 1):
        given = spark.createDataFrame([(*g, *map(float, v)) for g, v in at.items()], schema)
        for row in _slopes(cells, given, keys).collect():  # a row per group
            g = tuple(row[c] for c in keys)
            penalty = np.r_[0.0, at[g][1:]] * ridge
            grad[g] = np.array([row[f"g{i}"] for i in range(k + 1)]) + penalty
            h = np.array([[row[f"h{min(i, j)}{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + ridge * np.diag(np.r_[0.0, np.ones(k)])
            if _ < steps:
                at[g] = at[g] - np.linalg.solve(h, grad[g])
    out = []
    for g, v in at.items():
        coef = np.maximum(v[1:], 0.0)
        weights = coef / coef.sum() if coef.sum() > 0 else np.full(k, 1.0 / k)
        out += [(*g, b, float(weights[i]), float(v[1 + i]), float(grad[g][1 + i])) for i, b in enumerate(BRANCHES)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields[:len(keys)])
    return spark.createDataFrame(out, (fields + ", " if fields else "") + "branch string, weight double, coef double, gradient double")


def sql_fit(name: str, dev: str, group: str, steps: int = 12, ridge: float = 1.0) -> str:
    """CTEs for ``fit_weights``: ``name`` (group, b, c0, c1, c2, w_voice, w_graph, w_know), Newton steps with the elimination written out."""
    cols, n = [f"s_{b}" for b in BRANCHES], len(BRANCHES) + 1
    x = ["1", *[f"x{i}" for i in range(n - 1)]]
    parts = [f"""{name}_a AS (SELECT {group}, {", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))}, count(*) FILTER (is_genuine) AS gg, count(*) AS nn FROM {dev} GROUP BY ALL),
 {name}_x AS (SELECT {group}, {", ".join(x[1:])}, y, count(*) * nn / (2.0 * CASE WHEN y = 1 THEN gg ELSE nn - gg END) AS w
  FROM (SELECT {group}, {", ".join(f"coalesce({c}, m{i}) AS x{i}" for i, c in enumerate(cols))}, is_genuine::INT AS y, nn, gg FROM {dev} JOIN {name}_a USING ({group})) GROUP BY {group}, {", ".join(x[1:])}, y, nn, gg),
 {name}_0 AS (SELECT {group}, {", ".join(f"0.0::DOUBLE AS v{i}" for i in range(n))} FROM {name}_a)"""]
    for s in range(steps):
        at = f"{name}_{s}"
        sums = ", ".join([f"sum(w * (p - y) * {x[i]})" + (f" + {ridge} * any_value(v{i})" if i else "") + f" AS g{i}" for i in range(n)] +
                         [f"sum(w * p * (1 - p) * {x[i]} * {x[j]})" + (f" + {ridge}" if i == j and i else "") + f" AS h{i}{j}" for i in range(n) for j in range(i, n)])
        score = " + ".join(f"v{i} * {x[i]}" for i in range(n))
        parts.append(f"{at}_e0 AS (SELECT {group}, {sums}, {', '.join(f'any_value(v{i}) AS v{i}' for i in range(n))} FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM {name}_x JOIN {at} USING ({group})) GROUP BY ALL)")
        for k in range(n - 1):  # eliminate below the k-th pivot; the matrix stays symmetric
            keep = [group, *[f"v{i}" for i in range(n)], *[f"g{i}" for i in range(k + 1)], *[f"h{i}{j}" for i in range(k + 1) for j in range(i, n)]]
            made = [f"g{i} - h{k}{i} / h{k}{k} * g{k} AS g{i}" for i in range(k + 1, n)] + [f"h{i}{j} - h{k}{i} / h{k}{k} * h{k}{j} AS h{i}{j}" for i in range(k + 1, n) for j in range(i, n)]
            parts.append(f"{at}_e{k + 1} AS (SELECT {', '.join(keep + made)} FROM {at}_e{k})")
        prev = f"{at}_e{n - 1}"
        for k in range(n - 1, -1, -1):
            known = "".join(f" - h{k}{j} * d{j}" for j in range(k + 1, n))
            parts.append(f"{at}_b{k} AS (SELECT *, (g{k}{known}) / h{k}{k} AS d{k} FROM {prev})")
            prev = f"{at}_b{k}"
        parts.append(f"{name}_{s + 1} AS (SELECT {group}, {', '.join(f'v{i} - d{i} AS v{i}' for i in range(n))} FROM {prev})")
    pos = [f"greatest(v{i}, 0)" for i in range(1, n)]
    total = " + ".join(pos)
    parts.append(f"{name} AS (SELECT {group}, v0 AS b, {', '.join(f'v{i} AS c{i - 1}' for i in range(1, n))}, "
                 + ", ".join(f"CASE WHEN {total} > 0 THEN {pos[i]} / ({total}) ELSE {1.0 / (n - 1)!r} END AS w_{b}" for i, b in enumerate(BRANCHES)) + f" FROM {name}_{steps})")
    return ",\n ".join(parts)
