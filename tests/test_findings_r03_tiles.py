"""Trials by tiles, and what attack probes share."""

import numpy as np

from verilens.operators import nested as N
from verilens.operators import vectors as V


def test_trials_are_scored_a_tile_at_a_time(spark, monkeypatch):
    """Every pair once with its score, the same as by brute force, equal for equal vectors; no vector beside another in a row."""
    monkeypatch.setattr(V, "TILE_TRIALS", 200)
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(90, 8)), rng.normal(size=(7, 8))
    many = spark.createDataFrame([(i, i % 4, x[i % 80].tolist()) for i in range(90)] + [(900, 0, None)], "vec_id long, speaker long, v array<double>")
    few = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(c)], "claimed long, fold long, c array<double>")
    t = V.each_scored(many, few, ["claimed", "fold"], ["vec_id"])
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and t.columns == ["vec_id", "speaker", "claimed", "fold", "score"]
    got = {(r.vec_id, r.claimed): r.score for r in t.collect()}
    assert len(got) == 637 and all(got.pop((900, j)) is None for j in range(7))  # a vector that is its cohort's mean has no direction
    assert all(abs(s - x[i % 80] @ c[j]) < 1e-12 for (i, j), s in got.items())
    assert all(got[i, j] == got[i + 80, j] for i in range(10) for j in range(7))
    assert V.each_scored(many, few.limit(0), ["claimed", "fold"], ["vec_id"]).count() == 0


def test_a_strangers_own_vector_meets_the_cohort_once(spark, monkeypatch):
    """it is the same for every template it is aimed at; only blended vectors are searched for each."""
    rng = np.random.default_rng(3)
    roles = ["enrollee"] * 20 + ["norm"] * 30 + ["test"] * 12
    rows = [(i, i // 10 if r == "enrollee" else 50 + i % 5, i % 3, i % 2, r, (v / np.linalg.norm(v)).tolist()) for i, (r, v) in enumerate(zip(roles, rng.normal(size=(62, 8)), strict=True))]
    units = spark.createDataFrame(rows, "vec_id long, speaker long, session long, source long, role string, v array<double>")
    searched, search = [], V.top_k_stats
    monkeypatch.setattr(V, "top_k_stats", lambda items, *a: (searched.append(items.count()), search(items, *a))[1])
    t = N.attack_trials(units).collect()
    assert sorted(n for n in searched if n > 6) == [12, 12, 72, 72]  # six templates
    assert len(t) == 5 * 2 * 12 * 6 and len({(r.variant, r.attack, r.vec_id, r.claimed, r.fold) for r in t}) == len(t)
    assert all(r.score is not None for r in t)
