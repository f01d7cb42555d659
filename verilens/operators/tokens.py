"""Token statistics. Sequence work stays inside each utterance's array.

Previous labels, switches and same-label runs never cross an utterance, so they
are array expressions on the utterance row: no shuffle and no window. Only small
per-utterance or per-cell counts are ever exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.functions.arrays import compute_once, let

FIRST, SECOND = "A", "B"


def is_choice(lang: Column) -> Column:
    return lang.isin(FIRST, SECOND)


def choice_arrays(utts: DataFrame, floor: float = 0.0) -> DataFrame:
    """Add ``ch``: the utterance's choice tokens (confidence at least ``floor``) with the previous choice label."""
    ch = let(
        F.filter("toks", lambda t: is_choice(t["lang"]) & (t["conf"] >= floor)),
        lambda c: F.transform(c, lambda t, i: t.withField("prev", F.get(c, i - 1)["lang"])),
    )
    return compute_once(utts, utts.columns, ch=ch)


def utterance_stats(choices: DataFrame) -> DataFrame:
    """Per utterance: token, choice, switch, boundary and run counts (run lengths as sum and sum of squares)."""
    # One fold over the choice sequence: (current run, runs, sum of squares of closed runs).
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("sq"))

    def step(s, t):
        opens = t["prev"].isNull() | (t["prev"] != t["lang"])
        return F.struct(
            F.when(opens, F.lit(1).cast("long")).otherwise(s["run"] + 1).alias("run"),
            F.when(opens, s["runs"] + 1).otherwise(s["runs"]).alias("runs"),
            F.when(opens, s["sq"] + s["run"] * s["run"]).otherwise(s["sq"]).alias("sq"),
        )

    keep = [c for c in choices.columns if c not in ("toks", "ch")]
    base = compute_once(
        choices, keep, n_tokens=F.size("toks"), n_choice=F.size("ch"),
        n_first=F.size(F.filter("ch", lambda t: t["lang"] == FIRST)), _f=F.aggregate("ch", start, step),
    )
    f = F.col("_f")
    return base.select(
        *keep, "n_tokens", "n_choice", "n_first", F.greatest(f["runs"] - 1, F.lit(0)).alias("n_switches"),
        F.greatest(F.col("n_choice") - 1, F.lit(0)).alias("n_bounds"), f["runs"].alias("n_runs"),
        (f["sq"] + f["run"] * f["run"]).alias("run_sq"),
    )


def sequence_stats(utts: DataFrame) -> DataFrame:
    """``utterance_stats`` of utterances with ``n_tokens`` and ``seq``, the choice labels of their tokens as one string."""
    keep = [c for c in utts.columns if c not in ("words", "seq", "n_tokens")]
    n_choice, n_first = F.length("seq"), F.length(F.replace("seq", F.lit(SECOND), F.lit("")))
    run = compute_once(
        utts, [*keep, "n_tokens"], n_choice=n_choice, n_first=n_first, _r=F.regexp_extract_all("seq", F.lit(f"{FIRST}+|{SECOND}+"), F.lit(0)))
    squares = F.aggregate("_r", F.lit(0).cast("long"), lambda s, r: s + F.length(r).cast("long") * F.length(r))
    runs = F.size("_r").cast("long")
    return run.select(
        *keep, "n_tokens", "n_choice", "n_first", F.greatest(runs - 1, F.lit(0)).alias("n_switches"),
        F.greatest(F.col("n_choice") - 1, F.lit(0)).alias("n_bounds"), runs.alias("n_runs"), squares.alias("run_sq"))


def mixing(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled code-mixing metrics per key: CMI, M-index, I-index, burstiness, first-language share."""
    names = ["n_tokens", "n_choice", "n_first", "n_switches", "n_bounds", "n_runs", "run_sq"]
    s = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_utts"), *[F.sum(n).cast("long").alias(n) for n in names])
    n, a = F.col("n_choice"), F.col("n_first")
    share = a / n
    sq = share * share + (1 - share) * (1 - share)
    mean = n / F.col("n_runs")  # run lengths add up to the choice tokens
    var = (F.col("n_runs") * F.col("run_sq") - n * n) / (F.col("n_runs") * F.col("n_runs"))
    ratio = F.sqrt(F.greatest(var, F.lit(0.0))) / mean
    zero = F.lit(0.0)
    return s.select(
        *keys, "n_utts", "n_tokens", "n_choice", "n_first", "n_switches", "n_bounds", "n_runs",
        F.when(n > 0, 100 * (1 - F.greatest(a, n - a) / n)).otherwise(zero).alias("cmi"),
        F.when((n > 0) & (a > 0) & (a < n), (1 - sq) / sq).otherwise(zero).alias("m_index"),
        F.when(F.col("n_bounds") > 0, F.col("n_switches") / F.col("n_bounds")).otherwise(zero).alias("i_index"),
        F.when(F.col("n_runs") >= 2, (ratio - 1) / (ratio + 1)).otherwise(zero).alias("burstiness"),
        F.when(n > 0, share).otherwise(zero).alias("first_share"),
    )


def most_frequent(ascending: Column) -> Column:
    """Struct(token, n) of the most frequent entry of a sorted array, the lowest of equally frequent ones, by one fold over its runs."""
    start = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"))

    def step(s, w):
        run = F.when(s["last"] == w, s["run"] + 1).otherwise(F.lit(1))
        more = run > s["n"]
        return F.struct(F.when(more, w).otherwise(s["token"]).alias("token"), F.greatest(run, s["n"]).alias("n"), w.alias("last"), run.alias("run"))

    return F.aggregate(ascending, start, step, lambda s: F.struct(s["token"].alias("token"), s["n"].alias("n")))
