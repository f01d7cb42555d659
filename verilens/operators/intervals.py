"""Bootstrap intervals by Poisson weights drawn from seeded digests.

A resampled unit (a cluster of trials, or a score of a curve) carries the
weights of all replicates as one array, so that replicates never multiply
rows: sums over units are element-wise sums of arrays with map-side combine,
and prefixes of a curve are running sums of arrays in the bucketed scan.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.functions.arrays import compute_once, let
from verilens.functions.stats import hashed, uniform, wilson
from verilens.sources.held import hold

#: A percentile bootstrap over fewer clusters has too few different resamples to say much.
MIN_CLUSTERS = 5
#: Four-digit pieces of one digest.
_PIECES = 8


def poisson_steps(mean: int) -> tuple[int, list[str]]:
    """(least, steps): a piece of four hex digits draws the least number, and one more for each step that is not above the piece."""
    below, least, out = 0.0, 0, []
    for k in range(mean + 20 + 12 * math.isqrt(mean)):
        below += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        at = round(below * 65536)
        if at > 65535:
            break
        if at == 0:
            least += 1
        else:
            out.append(f"{at:04x}")
    return least, out


#: Means of which numbers of trials are made up: powers of two, the last as often as it takes.
MEANS = [1 << b for b in range(11)]
#: Poisson(1) draws.
POISSON_STEPS = poisson_steps(1)[1]


def pieces(replicates: int, seed: object, *key: Column) -> Column:
    """Array of a uniform 16-bit number for each replicate, as four hex digits, from digests of the seed, a block number and the key."""
    blocks = -(-replicates // _PIECES)
    each = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: let(
        hashed(seed, b, *key), lambda d: F.array(*[F.substring(d, 1 + 4 * i, 4) for i in range(_PIECES)])))
    return F.slice(F.flatten(each), 1, replicates)


def weights(replicates: int, seed: object, *key: Column) -> Column:
    """Array of Poisson(1) weights, one a replicate."""
    steps = F.array(*[F.lit(s) for s in POISSON_STEPS])
    return F.transform(pieces(replicates, seed, *key), lambda p: F.size(F.filter(steps, lambda s: s <= p)))


def digests(replicates: int, seed: object, *key: Column) -> Column:
    """The digests that ``pieces`` are cut from, one after another in one string of hex digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // _PIECES) - 1)), lambda b: hashed(seed, b, *key)), "")


def poisson_draws(replicates: int):
    """Function of (place in ``MEANS``, digests): the Poisson draw of each replicate, by binary search in the steps of the mean."""
    tables = [(least, np.array([int(s, 16) for s in steps], np.uint16)) for least, steps in map(poisson_steps, MEANS)]

    @F.pandas_udf("array<int>")
    def draw(place: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for p, d in zip(place, text, strict=True):
            least, steps = tables[p]
            u = np.frombuffer(bytes.fromhex(d), ">u2")[:replicates].astype(np.uint16)
            out.append((least + np.searchsorted(steps, u, "right")).astype(np.int32))
        return pd.Series(out, dtype=object)

    return draw


def sql_pieces(replicates: int, seed: object, key: str) -> str:
    """DuckDB SQL for the same numbers; ``key`` lists the key's columns."""
    return (f"flatten([[substr(d, 1 + 4 * i, 4) FOR i IN range({_PIECES})] FOR d IN "
            f"[md5(concat_ws('|', '{seed}', b, {key})) FOR b IN range({-(-replicates // _PIECES)})]])[1:{replicates}]")


def sql_weights(replicates: int, seed: object, key: str) -> str:
    """DuckDB SQL for the same weights."""
    draw = " + ".join(f"(p >= '{s}')::INT" for s in POISSON_STEPS)
    return f"[{draw} FOR p IN {sql_pieces(replicates, seed, key)}]"


#: Cumulative Poisson(1) probabilities, as far as a 32-bit number can tell them from one.
POISSON1 = [p for p in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(16)) if 1 - p > 2.0**-32]


def fine_weights(replicates: int, seed: object, *key: Column) -> Column:
    """Array of Poisson(1) weights, one a replicate, each from a digest and 32 bits of its own."""
    def draw(rep):
        return let(uniform(seed, rep, *key), lambda u: functools.reduce(lambda w, kp: F.when(u < kp[1], F.lit(kp[0])).otherwise(w), reversed(list(enumerate(POISSON1))), F.lit(len(POISSON1))))

    return F.transform(F.sequence(F.lit(1), F.lit(replicates)), draw)


def sql_fine_weight(seed: object, rep: str, key: str) -> str:
    """DuckDB SQL for the same weight of one replicate."""
    u = f"(('0x' || substr(md5(concat_ws('|', '{seed}', {rep}, {key})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"len([p FOR p IN {POISSON1!r}::DOUBLE[] IF {u} >= p])"


def array_sum(array: Column) -> Column:
    """Aggregate: element-wise sum of arrays of numbers."""
    return vector_to_array(Summarizer.sum(array_to_vector(array.cast("array<double>"))))


def array_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array."""
    at = F.lit(q) * (F.size(values) - 1)
    low = F.get(values, F.floor(at).cast("int"))
    return low + (F.get(values, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def _percentiles(df: DataFrame, keep: Sequence[str], rates: Column, few: Column) -> DataFrame:
    """``keep`` with lo and hi: the 95% range of an array of rates without its nulls; (0, 1) where there are too few units."""
    made = compute_once(df.withColumn("_few", few), [*keep, "_few"], _r=F.array_sort(F.array_compact(rates)))
    low, high = (F.when(F.col("_few"), edge).otherwise(array_quantile(F.col("_r"), q)) for edge, q in ((0.0, 0.025), (1.0, 0.975)))
    return made.select(*keep, low.alias("lo"), high.alias("hi"))


def cluster_rate(clusters: DataFrame, keys: Sequence[str], cluster: str, replicates: int, seed: int, draw=weights) -> DataFrame:
    """Pooled rate k / n of ``clusters`` (keys, cluster, k, n) and its 95% percentile interval over resampled clusters; (0, 1) under two clusters."""
    w = draw(replicates, seed, *[F.col(c) for c in keys], F.col(cluster))
    times = lambda c: F.transform("_w", lambda x: x * F.col(c))
    drawn = compute_once(compute_once(clusters, [*keys, "k", "n"], _w=w), [*keys, "k", "n"], _wk=times("k"), _wn=times("n"))
    sums = drawn.groupBy(*keys).agg(
        F.sum("k").alias("_sk"), F.sum("n").alias("_sn"), F.count_if(F.col("n") > 0).alias("n_clusters"), array_sum(F.col("_wk")).alias("_k"), array_sum(F.col("_wn")).alias("_n"))
    sums = sums.withColumnsRenamed({"_sk": "k", "_sn": "n"})
    rates = F.zip_with("_k", "_n", lambda a, b: F.try_divide(a, b))
    return _percentiles(sums.withColumn("rate", F.try_divide("k", "n")), [*keys, "k", "n", "n_clusters", "rate"], rates, F.col("n_clusters") < 2)


def reported_interval(clusters: DataFrame, keys: Sequence[str], cluster: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, k, n, n_clusters, rate, lo, hi, informative): the wider of Wilson's interval and the cluster bootstrap's.

    A percentile bootstrap over a few clusters is too narrow, and without
    events it is a point; Wilson's is the least that is reported.
    ``informative`` says whether the clusters add anything: at least
    ``MIN_CLUSTERS`` of them, and an event.
    """
    c = cluster_rate(clusters, keys, cluster, replicates, seed)
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select(
        *keys, "k", "n", "n_clusters", "rate", F.least(low, F.col("lo")).alias("lo"), F.greatest(high, F.col("hi")).alias("hi"),
        ((F.col("n_clusters") >= MIN_CLUSTERS) & (F.col("k") > 0)).alias("informative"))


def sql_reported(name: str, source: str, keys: str, cluster: str, replicates: int = 1000, seed: int = 7) -> str:
    """CTEs for ``reported_interval``: ``name`` (keys, k, n, n_clusters, rate, lo, hi, informative) of ``source`` (keys, cluster, k, n)."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(","))
    p = "(k / nullif(n, 0)::DOUBLE)"
    mid = f"({p} + 3.8416 / (2 * n)) / (1 + 3.8416 / n)"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n))"
    return f"""{name}_w AS (SELECT {keys}, k, n, unnest({sql_weights(replicates, seed, f"{keys}, {cluster}")}) AS w, unnest(range({replicates})) AS rep FROM {source}),
 {name}_r AS (SELECT {keys}, rep, sum(w * k) / nullif(sum(w * n), 0)::DOUBLE AS r FROM {name}_w GROUP BY ALL),
 {name}_q AS (SELECT {keys}, quantile_cont(r, 0.025) AS q_lo, quantile_cont(r, 0.975) AS q_hi FROM {name}_r GROUP BY ALL),
 {name}_s AS (SELECT {keys}, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n, count(*) FILTER (n > 0) AS n_clusters FROM {source} GROUP BY ALL),
 {name} AS (SELECT a.*, {p} AS rate, least(CASE WHEN n = 0 THEN 0 ELSE greatest(0, {mid} - {half}) END, CASE WHEN n_clusters < 2 THEN 0 ELSE q_lo END) AS lo,
  greatest(CASE WHEN n = 0 THEN 1 ELSE least(1, {mid} + {half}) END, CASE WHEN n_clusters < 2 THEN 1 ELSE q_hi END) AS hi,
  n_clusters >= {MIN_CLUSTERS} AND k > 0 AS informative FROM {name}_s a JOIN {name}_q b ON {on})"""


def _draws(cells: DataFrame, keys: Sequence[str], replicates: int, seed: object) -> DataFrame:
    """(keys, t, _g, _i): for each cell the numbers of genuine and impostor trials, first its own, then one of each replicate.

    A resample of n trials with replacement is near Poisson(n) of each kind. n is
    made up of powers of two up to the largest of ``MEANS``, and every part is
    one Poisson draw by inversion: one rule for any n, and a cell of very many
    trials is a number of rows that tasks share.
    """
    top = len(MEANS) - 1
    n = F.col("_n")
    bits = F.filter(F.transform(F.array(*[F.lit(b) for b in range(top)]), lambda b: F.struct(b.alias("_p"), F.lit(0).cast("long").alias("_c"))),
                    lambda x: F.pmod(F.floor(n / F.pow(F.lit(2), x["_p"])), F.lit(2)) == 1)
    chunks = F.floor(n / MEANS[top])
    whole = F.when(chunks > 0, F.transform(F.sequence(F.lit(1).cast("long"), chunks), lambda c: F.struct(F.lit(top).alias("_p"), c.alias("_c"))))
    parts = F.concat(bits, F.coalesce(whole, F.array().cast("array<struct<_p:int,_c:bigint>>")))
    sides = cells.select(*keys, "t", F.inline(F.array(F.struct(F.lit("g").alias("_side"), F.col("n_gen").alias("_n")), F.struct(F.lit("i").alias("_side"), F.col("n_imp").alias("_n")))))
    units = sides.filter("_n > 0").select(*keys, "t", "_side", F.inline(parts))
    cell = F.round(F.col("t"), 9) + F.lit(0.0)  # equal scores of two engines give equal digests
    hexes = digests(replicates, seed, *[F.col(k) for k in keys if not k.startswith("_")], F.format_number(cell, 9), F.col("_side"), F.col("_p"), F.col("_c"))
    drawn = compute_once(units, [*keys, "t", "_side", "_p"], _x=hexes).withColumn("_u", poisson_draws(replicates)("_p", "_x"))
    drawn = compute_once(drawn, [*keys, "t", "_side"], _d=F.concat(F.array(F.expr("shiftleft(1, _p)")), F.col("_u")))
    zero = F.array_repeat(F.lit(0), replicates + 1)
    of = lambda side: array_sum(F.when(F.col("_side") == side, F.col("_d")).otherwise(zero))
    return drawn.groupBy(*keys, "t").agg(of("g").alias("_g"), of("i").alias("_i"))


def _running(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    """Add inclusive running element-wise sums of an array column."""
    from pyspark.sql import Window

    here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = Summarizer.metrics("sum").summary(array_to_vector(F.col(column).cast("array<double>"))).over(here)
    return df.withColumn("_s", summed).withColumn(name, vector_to_array(F.col("_s.sum"))).drop("_s")


def eer_interval(trials: DataFrame, groups: Sequence[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(groups, eer, lo, hi): the exact curve's EER, and its 95% interval over resampled genuine and impostor scores.

    First only value buckets of scores are summed: FAR - FRR never rises along
    the thresholds, so each replicate crosses zero in one bucket. Scores in
    those buckets are then scanned one by one, and each replicate's EER is read
    off at the score where it crosses. Replicates without trials of a kind are
    left out.
    """
    from verilens.operators.scan import value_bucket

    hist = trials.filter(F.col("score").isNotNull()).groupBy(*groups, F.col("score").alias("t")).agg(
        F.count_if("is_genuine").alias("n_gen"), F.count_if(~F.col("is_genuine")).alias("n_imp")).withColumn("_b", value_bucket(F.col("t"))).transform(hold)
    cell = [*groups, "_b"]
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    totals = _draws(hist, cell, replicates, seed).groupBy(*cell).agg(array_sum(F.col("_g")).alias("_g"), array_sum(F.col("_i")).alias("_i"))
    cum = _running(_running(totals, groups, "_b", "_g", "_cg"), groups, "_b", "_i", "_ci").transform(hold)
    whole = cum.groupBy(*groups).agg(F.max_by("_cg", "_b").alias("_all_g"), F.max_by("_ci", "_b").alias("_all_i"))
    # rate differences before and after: accept from here on, and from the next score on
    gap = lambda g, i, r: F.try_divide(F.get("_all_i", r) - F.get(i, r), F.get("_all_i", r)) - F.try_divide(F.get(g, r), F.get("_all_g", r))
    crossing = F.filter(F.sequence(F.lit(0), F.lit(replicates)), lambda r: (gap("_bg", "_bi", r) > 0) & (gap("_cg", "_ci", r) <= 0))

    def crossed(df: DataFrame, keep: list[str]) -> DataFrame:
        df = compute_once(df, [*keep, "t", "_cg", "_ci", "_all_g", "_all_i", "_g", "_i"] if "t" in df.columns else [*keep, "_cg", "_ci", "_all_g", "_all_i", "_g", "_i"], _bg=less("_cg", "_g"), _bi=less("_ci", "_i"))
        return compute_once(df, [c for c in df.columns], _at=crossing).filter(F.size("_at") > 0)

    # the broadcast side is one row a group
    found = crossed(cum.join(F.broadcast(whole), list(groups)), cell)
    open_cells = found.select(*cell, F.col("_bg").alias("_before_g"), F.col("_bi").alias("_before_i"), "_all_g", "_all_i").transform(hold)
    fine = _draws(hist.join(open_cells.select(*cell), cell, "left_semi"), cell, replicates, seed)
    fine = _running(_running(fine, cell, "t", "_g", "_rg"), cell, "t", "_i", "_ri").join(open_cells, cell)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fine = compute_once(fine, [*groups, "t", "_g", "_i", "_all_g", "_all_i"], _cg=plus("_rg", "_before_g"), _ci=plus("_ri", "_before_i"))
    at = crossed(fine, list(groups)).select(*groups, "t", F.explode("_at").alias("rep"), "_bg", "_bi", "_cg", "_ci", "_all_g", "_all_i")
    pick = lambda c: F.get(c, F.col("rep"))
    at = at.select(*groups, "t", "rep", *[pick(c).alias(c[1:]) for c in ("_bg", "_bi", "_cg", "_ci", "_all_g", "_all_i")])
    far0, frr0 = (F.col("all_i") - F.col("bi")) / F.col("all_i"), F.col("bg") / F.col("all_g")
    far1, frr1 = (F.col("all_i") - F.col("ci")) / F.col("all_i"), F.col("cg") / F.col("all_g")
    a = (far0 - frr0) / ((far0 - frr0) - (far1 - frr1))
    last = (F.col("cg") == F.col("all_g")) & (F.col("ci") == F.col("all_i"))
    eer = F.when(F.col("t") == float("-inf"), (far1 + frr1) / 2).when(last, (far0 + frr0) / 2).otherwise(far0 + a * (far1 - far0))
    rows = at.select(*groups, "rep", eer.alias("e"))
    out = rows.groupBy(*groups).agg(F.max(F.when(F.col("rep") == 0, F.col("e"))).alias("eer"), F.collect_list(F.when(F.col("rep") > 0, F.col("e"))).alias("_e"))  # as many as replicates
    return _percentiles(out, [*groups, "eer"], F.col("_e"), F.size("_e") < 1)


def sql_eer_interval(name: str, source: str, group: str, replicates: int = 1000, seed: int = 0) -> str:
    """CTEs for ``eer_interval``: ``name`` (group, eer, lo, hi), every replicate's curve by plain windows."""
    means = ", ".join(f"({b}, {least}, [{', '.join(repr(x) for x in steps)}])" for b, (least, steps) in ((b, poisson_steps(m)) for b, m in enumerate(MEANS)))
    top = len(MEANS) - 1
    return f"""{name}_p(p, least, steps) AS (VALUES {means}),
 {name}_h AS (SELECT {group}, score AS t, 'g' AS side, count(*) AS n FROM {source} WHERE is_genuine AND score IS NOT NULL GROUP BY ALL
  UNION ALL SELECT {group}, score, 'i', count(*) FROM {source} WHERE NOT is_genuine AND score IS NOT NULL GROUP BY ALL),
 {name}_u AS (SELECT {group}, t, side, unnest([{{'p': b, 'c': 0}} FOR b IN range({top}) IF (n // (1 << b)::BIGINT) % 2 = 1] || [{{'p': {top}, 'c': c}} FOR c IN range(1, n // {MEANS[top]} + 1)]) AS part FROM {name}_h),
 {name}_v AS (SELECT {group}, t, side, part.p AS p, part.c AS c, {sql_pieces(replicates, seed, f"{group}, CASE WHEN t = '-inf' THEN '-∞' ELSE format('{{:,.9f}}', t) END, side, part.p, part.c")} AS u FROM {name}_u),
 {name}_w AS (SELECT {group}, t, side, rep, sum(least + k) AS w FROM (SELECT {group}, t, side, least, unnest(range(1, {replicates + 1})) AS rep, unnest([len([1 FOR s IN steps IF s <= x]) FOR x IN u]) AS k
  FROM {name}_v v JOIN {name}_p p ON p.p = v.p) GROUP BY ALL UNION ALL SELECT {group}, t, side, 0, n FROM {name}_h),
 {name}_c AS (SELECT {group}, rep, t, coalesce(sum(w) FILTER (side = 'g'), 0) AS g, coalesce(sum(w) FILTER (side = 'i'), 0) AS i FROM {name}_w GROUP BY ALL HAVING sum(w) > 0),
 {name}_o AS (SELECT *, sum(g) OVER a AS ag, sum(i) OVER a AS ai, coalesce(sum(g) OVER b, 0) AS bg, coalesce(sum(i) OVER b, 0) AS bi FROM {name}_c
  WINDOW a AS (PARTITION BY {group}, rep), b AS (PARTITION BY {group}, rep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 {name}_d AS (SELECT *, (ai - bi) / ai::DOUBLE AS far, bg / ag::DOUBLE AS frr FROM {name}_o WHERE ag > 0 AND ai > 0 AND t > '-inf'),
 {name}_x AS (SELECT {group}, rep, arg_max({{'far': far, 'frr': frr}}, t) FILTER (far > frr) AS up, arg_min({{'far': far, 'frr': frr}}, t) FILTER (far <= frr) AS down FROM {name}_d GROUP BY ALL),
 {name}_e AS (SELECT {group}, rep, CASE WHEN up IS NULL THEN (down.far + down.frr) / 2 WHEN down IS NULL THEN (up.far + up.frr) / 2
  ELSE up.far + (up.far - up.frr) / ((up.far - up.frr) - (down.far - down.frr)) * (down.far - up.far) END AS e FROM {name}_x),
 {name} AS (SELECT {group}, max(e) FILTER (rep = 0) AS eer, quantile_cont(e, 0.025) FILTER (rep > 0) AS lo, quantile_cont(e, 0.975) FILTER (rep > 0) AS hi FROM {name}_e GROUP BY ALL)"""
