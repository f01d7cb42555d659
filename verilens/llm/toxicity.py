"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text and their beginnings of three to
seven letters (log of one plus the count). A grade k is reached with
probability sigmoid(w.x - t_k): the weights w are shared by all thresholds
t_1 < t_2 < ..., and the output is the expected grade. A text is toxic if its
probability of grade 1 or more is at least ``limit``.

``labels`` gives 0 or 1 a document. Severity grades are made from them by
``graded``: 0 for clean texts; toxic texts get 1, 2 or 3 by how many words
begin like words that only toxic texts have (under 3, under 6, more).

The fit takes a sample of labelled documents: those whose hashed id falls
below ``MAX_FIT`` over the number of labels, about ``MAX_FIT`` rows. Equal
texts of the sample count once. Everything else reads all rows.

Defined cases: a null text counts as empty and gets the grade of no evidence;
rows without a label, with a null label or a null id take no part in the fit;
several labels of an id count as their maximum; without labels of both kinds
every document is clean; repeated rows are scored alike; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilens.llm.common import free_name, stored, text_of

#: Labelled documents in the fit at most (on average; the hash decides).
MAX_FIT = 40_000
#: Features in the model at most, the ones that tell toxic from clean texts best.
MAX_FEATURES = 4_096
#: A feature is used if so many different texts of the sample have it.
LEAST_TEXTS = 4
GRADES = 3
#: Texts of the sample that a step of the fit takes at once.
BLOCK = 2_000
#: Words whose features a task remembers.
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_CUTS = (3, 4, 5, 6, 7)


def features(text: str) -> Counter:
    """Counts of words ('=word') and of word beginnings."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        out["=" + word] += n
        for k in _CUTS:
            if len(word) >= k:
                out[word[:k]] += n
    return out


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that have a feature, by label."""
    for df in batches:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(df["text"], df["toxic"], strict=True):
            n[toxic].update(features(text).keys())
        names = list(n[0].keys() | n[1].keys())
        if names:
            yield pd.DataFrame({"feature": names, "clean": [n[0][x] for x in names], "toxic": [n[1][x] for x in names]})


class Ordinal:
    """P(grade >= k) = sigmoid(w.x - t_k) with rising t."""

    def __init__(self, names: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.names, self.weights, self.cuts = names, weights, cuts

    def chances(self, score: np.ndarray) -> np.ndarray:
        """A row per text, a column per grade from 1: the chance of that grade or more."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))

    @classmethod
    def fit(cls, names: list[str], sizes: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> Ordinal:
        """Maximum penalised likelihood by Adam over the whole (sparse) sample: ``sizes`` features a text, text after text.

        The likelihood of grade g is P(>= g) - P(>= g + 1). Thresholds stay in order as a first value and logs of gaps.
        A step walks through the sample in blocks of texts, so that only one block's terms are held at a time.
        """
        n, top, f = len(grade), max(1, int(grade.max(initial=0))), len(names)
        base = np.clip(np.array([(grade >= k).mean() for k in range(1, top + 1)]), 1e-6, 1 - 1e-6)
        first = -np.log(base / (1 - base))
        gaps = np.maximum(np.diff(first), 1e-2)
        p = np.concatenate([np.zeros(f), first[:1], np.log(gaps)])
        m, v = np.zeros_like(p), np.zeros_like(p)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for step in range(1, steps + 1):
            t = np.cumsum(np.concatenate([p[f:f + 1], np.exp(p[f + 1:])]))
            d_w, d_t = np.zeros(f), np.zeros(top + 2)
            for a in range(0, n, BLOCK):
                b = min(n, a + BLOCK)
                x, k, g = value[ends[a]:ends[b]].astype(float), column[ends[a]:ends[b]], grade[a:b]
                row, at = np.repeat(np.arange(b - a), sizes[a:b]), np.arange(b - a)
                score = np.bincount(row, x * p[k], b - a)
                c = np.concatenate([np.ones((b - a, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -50, 50))), np.zeros((b - a, 1))], 1)
                upper, lower = c[at, g], c[at, g + 1]
                chance = np.maximum(upper - lower, 1e-12)
                du, dl = upper * (1 - upper) / chance / n, lower * (1 - lower) / chance / n  # d log chance / d (score - t)
                d_w += np.bincount(k, x * (dl - du)[row], f)
                d_t += np.bincount(g, du, top + 2) - np.bincount(g + 1, dl, top + 2)
            tail = np.cumsum(d_t[top:0:-1])[::-1]
            step_g = np.concatenate([d_w + ridge * p[:f], tail[:1], tail[1:] * np.exp(p[f + 1:])])
            m, v = 0.9 * m + 0.1 * step_g, 0.999 * v + 0.001 * step_g * step_g
            p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(names, p[:f], np.cumsum(np.concatenate([p[f:f + 1], np.exp(p[f + 1:])])))


def graded(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Severity from the label and the number of words like those of toxic texts alone."""
    return np.where(toxic == 1, 1 + (hits >= 3) + (hits >= 6), 0).astype(int)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    within = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MAX_FIT / max(1, n)))
    text = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(within)
    few = known.filter(within)  # about MAX_FIT rows, whatever the number of labels
    sample = stored(text.join(F.broadcast(few), "id").groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    seen = sample.mapInPandas(_seen, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = sample.groupBy().agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    if not both.n or not both.a or both.a == both.n:
        return Ordinal([], np.empty(0), np.full(GRADES, 50.0))
    a, b = int(both.a), int(both.n) - int(both.a)
    rate_a, rate_b = (F.col("toxic") + 0.5) / (a + 1), (F.col("clean") + 0.5) / (b + 1)
    weight = F.abs(F.log(rate_a / rate_b)) * F.sqrt(F.greatest("toxic", "clean"))
    strong = seen.filter(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).withColumn("strength", weight)
    picked = strong.orderBy(F.desc("strength"), "feature").limit(MAX_FEATURES).collect()  # bounded
    names = [r.feature for r in picked]
    signs = {r.feature for r in picked if r.clean == 0 and not r.feature.startswith("=")}
    place = {x: i for i, x in enumerate(names)}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            columns, values, hits = [], [], []
            for text in df["text"]:
                found = features(text)
                own = [(place[x], c) for x, c in found.items() if x in place]
                columns.append(np.array([i for i, _ in own], "<i4").tobytes())
                values.append(np.log1p([c for _, c in own]).astype("<f4").tobytes())
                hits.append(sum(c for w, c in Counter(_WORD.findall(text.lower())).items() if any(w[:k] in signs for k in _CUTS)))
            yield pd.DataFrame({"toxic": df["toxic"], "hits": hits, "columns": columns, "values": values})

    rows = sample.mapInPandas(sparse, "toxic int, hits long, columns binary, values binary").toArrow()  # at most about MAX_FIT rows
    columns = rows["columns"].to_pylist()
    sizes = np.array([len(x) // 4 for x in columns])
    column, value = np.frombuffer(b"".join(columns), "<i4"), np.frombuffer(b"".join(rows["values"].to_pylist()), "<f4")
    grade = graded(rows["toxic"].to_numpy(), rows["hits"].to_numpy())
    del rows, columns
    return Ordinal.fit(names, sizes, column, value, grade)


def scored(docs: DataFrame, model: Ordinal, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade), chance (of grade 1 or more) and is_toxic; names that ``docs`` has get longer ones."""
    weights = dict(zip(model.names, model.weights.tolist(), strict=True))
    cuts = model.cuts

    known: dict[str, list[str]] = {}

    def used(word: str) -> list[str]:
        """The features of a word that the model has."""
        if word not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = [x for x in ("=" + word, *(word[:k] for k in _CUTS if len(word) >= k)) if x in weights]
        return known[word]

    @F.pandas_udf("struct<severity: double, chance: double, is_toxic: boolean>")
    def score(text: pd.Series) -> pd.DataFrame:
        sums = np.zeros(len(text))
        for i, x in enumerate(text):
            counts: dict[str, int] = {}
            for word, n in Counter(_WORD.findall(x.lower())).items():
                for feature in used(word):
                    counts[feature] = counts.get(feature, 0) + n
            sums[i] = math.fsum(weights[feature] * math.log1p(n) for feature, n in counts.items())
        chances = Ordinal([], np.empty(0), cuts).chances(sums)
        return pd.DataFrame({"severity": chances.sum(1), "chance": chances[:, 0], "is_toxic": chances[:, 0] >= limit})

    own = free_name(docs, "scored")
    made = docs.withColumn(own, score(text_of(text_col)))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{own}.{c}").alias(free_name(docs, c)) for c in ("severity", "chance", "is_toxic")])


def clean(docs: DataFrame, model: Ordinal, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that aren't toxic, in their own columns."""
    made = scored(docs, model, limit, text_col)
    return made.filter(~F.col(free_name(docs, "is_toxic"))).select(*[F.col(f"`{c}`") for c in docs.columns])
