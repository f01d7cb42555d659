"""Answer, phrase and vocabulary matching."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verilens.functions import text as X
from verilens.functions.arrays import compute_once, let
from verilens.sources.held import hold

PHONETIC_WEIGHT = 0.95
METHODS = ("exact", "entity", "phonetic")


def match_scores(pairs: DataFrame, answer: str, expected: str) -> DataFrame:
    """Add exact, entity and phonetic scores, the fused score and the winning method (first of equals)."""
    keep = list(pairs.columns)
    n = compute_once(pairs, keep, _a=X.normalise(F.col(answer)), _e=X.normalise(F.col(expected)))
    k = compute_once(n, [*keep, "_a", "_e"], _ak=X.phonetic_key(F.col("_a")), _ek=X.phonetic_key(F.col("_e")))
    s = compute_once(k, keep, exact=X.exact_match(F.col("_a"), F.col("_e")), entity=X.entity_match(F.col("_a"), F.col("_e")),
                     phonetic=X.phonetic_match(F.col("_ak"), F.col("_ek")))
    best = F.array_max(F.array(*[F.struct((F.col(m) * (PHONETIC_WEIGHT if m == "phonetic" else 1.0)).alias("s"), F.lit(-i).alias("o"), F.lit(m).alias("m")) for i, m in enumerate(METHODS)]))
    return s.withColumn("_b", best).select(*keep, *METHODS, F.least(F.lit(1.0), F.col("_b.s")).alias("fused"), F.col("_b.m").alias("method"))


def phrase_hits(expected: Column, heard: Column, close: Column | None = None) -> Column:
    """Greedy in-order match: each expected word is sought after the previous hit. Struct(hits, missing).

    ``close`` maps a heard word to the expected words it also counts as.
    """
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("missing"))

    def step(s, w):
        rest = F.slice(heard, s["pos"] + 1, F.greatest(F.size(heard), F.lit(1)))
        if close is None:
            at_first = F.array_position(rest, w)
        else:
            others = F.map_keys(F.map_filter(close, lambda _, ws: F.array_contains(ws, w)))
            places = F.filter(F.transform(F.concat(F.array(w), others), lambda x: F.array_position(rest, x)), lambda at: at > 0)
            at_first = F.coalesce(F.array_min(places), F.lit(0))
        return let(at_first.cast("int"), lambda at: F.when(at > 0, F.struct(
            (s["pos"] + at).alias("pos"), F.concat(s["hits"], F.array(s["pos"] + at)).alias("hits"), s["missing"].alias("missing"))).otherwise(
            F.struct(s["pos"].alias("pos"), s["hits"].alias("hits"), F.concat(s["missing"], F.array(w)).alias("missing"))))

    return F.aggregate(expected, start, step)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two short words."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def with_close_words(phrases: DataFrame, key: str, ratio: float = 0.8) -> DataFrame:
    """Add ``close``: heard word -> expected words within the fuzzy ratio.

    ``phrases`` has (key, expected, heard). A pair stays in its row until it is known to be near: the ratio needs
    an edit distance of at most (1 - ratio) of both lengths, which the built-in distance checks with a bound, and
    only distinct pairs within it reach Python.
    """
    both = phrases.select(key, "heard", F.explode(F.array_distinct("expected")).alias("w")).filter("w IS NOT NULL")
    pairs = both.select(key, "w", F.explode(F.array_distinct("heard")).alias("h"))
    total = F.length("w") + F.length("h")
    may = (F.col("w") != F.col("h")) & (2 * F.least(F.length("w"), F.length("h")) / total >= ratio)
    close_by = F.expr(f"levenshtein(w, h, CAST(floor({1 - ratio!r} * (length(w) + length(h)) + 1e-9) AS INT)) >= 0")
    pairs = pairs.filter(may).filter(close_by).distinct().transform(hold)
    near = pairs.select("w", "h").distinct().withColumn("r", sequence_ratio("w", "h")).filter(F.col("r") >= ratio)
    words = pairs.join(near, ["w", "h"]).groupBy(key, "h").agg(F.collect_set("w").alias("ws"))
    close = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("h", "ws"))).alias("close"))
    none = F.create_map().cast("map<string,array<string>>")
    return phrases.join(close, key, "left").withColumn("close", F.coalesce("close", none))


def fuzzy_pairs(words: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Pairs of distinct words with edit ratio at least ``ratio``, found exactly without comparing all pairs.

    Two words within d edits share at least one of the d + 1 segments of the longer
    one, displaced by at most d. Segments are an equi-join key; the edit distance is
    computed for candidates only.
    """
    tol = 1e-9
    n = F.length("word")
    d = F.floor((1 - ratio) * n + tol).cast("int")
    longer = words.withColumn("n", n).withColumn("d", d).filter("d > 0")
    seg = longer.select("word", "n", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    a, b = F.floor(F.col("i") * F.col("n") / (F.col("d") + 1)).cast("int"), F.floor((F.col("i") + 1) * F.col("n") / (F.col("d") + 1)).cast("int")
    seg = seg.select(F.col("word").alias("long"), "n", "i", F.expr("word").substr(a + 1, b - a).alias("seg"))
    other = words.withColumn("m", n)
    probe = other.select("word", F.explode(F.sequence(F.col("m"), F.floor(F.col("m") / ratio + tol).cast("int"))).alias("n"))
    probe = probe.withColumn("d", F.floor((1 - ratio) * F.col("n") + tol).cast("int")).filter("d > 0")
    probe = probe.select("word", "n", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i")).select("word", "n", "d", "i", a.alias("a"), b.alias("b"))
    probe = probe.select("word", "n", "i", "a", "b", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - F.col("d")), F.col("a") + F.col("d"))).alias("p"))
    probe = probe.select(F.col("word").alias("short"), "n", "i", F.expr("word").substr(F.col("p") + 1, F.col("b") - F.col("a")).alias("seg")).distinct()
    cand = seg.join(probe, ["n", "i", "seg"]).filter(F.col("long") != F.col("short")).select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b")).distinct()
    return cand.withColumn("ratio", X.similarity(F.col("a"), F.col("b"))).filter(F.col("ratio") >= ratio - tol)
