"""Nested protocols leak nothing; intervals, fits, versioned tables and erasure against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verilens.operators import corpus as H
from verilens.operators import erasure as E
from verilens.operators import fusion as M
from verilens.operators import intervals as I
from verilens.operators import nested as N
from verilens.operators import vectors as V
from verilens.operators.fusion import BRANCHES
from verilens.sources import versioned

SCHEMA = "vec_id long, speaker long, session long, source long, v array<double>"


def some_units(spark, seed=0, speakers=10, each=9, dim=6):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(speakers):
        centre = rng.normal(size=dim)
        for i in range(each):
            rows.append((s * 100 + i, s, i % 3, s % 2, (centre + rng.normal(size=dim)).tolist()))
    return V.unit_vectors(spark.createDataFrame(rows, SCHEMA))


def with_roles(u):
    return N.in_roles(u.drop("source"), N.roles(u, "source", "speaker").toDF("stratum", "unit", "role"))


def test_templates_leave_out_both_sittings(spark):
    u = some_units(spark).filter("speaker < 3")
    rows = u.collect()
    got = {(r.claimed, r.fold, r.inner): np.array(r.c) for r in N.templates(u).collect()}
    assert len(got) == 3 * 9
    for (s, fold, inner), c in got.items():
        want = sum(np.array(r.v) for r in rows if r.speaker == s and r.session not in (fold, inner))
        assert c == pytest.approx(want / np.linalg.norm(want))


def test_parts_share_neither_strangers_nor_sittings(spark):
    u = with_roles(some_units(spark))
    role = {r.speaker: r.role for r in u.select("speaker", "role").distinct().collect()}
    assert sorted(role.values()).count("enrollee") == 2 and {"norm", "fit", "test"} <= set(role.values())
    for r in N.trials(u, N.templates(u.filter("role = 'enrollee'"))).collect():
        assert (r.part == "test") == (r.fold == r.inner)
        if r.is_genuine:
            assert r.session == r.inner
        else:
            assert role[r.probe_speaker] == ("test" if r.part == "test" else "fit")


def test_moving_test_material_moves_no_threshold(spark):
    """Vectors of test strangers, and those of a held-out sitting, can't reach the thresholds of its fold."""
    u = with_roles(some_units(spark))
    owner = u.filter("role = 'enrollee'").agg(F.min("speaker")).first()[0]
    turned = F.transform("v", lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(-1))
    held_out = (F.col("role") == "test") | ((F.col("speaker") == owner) & (F.col("session") == 2))
    moved = u.withColumn("v", F.when(held_out, turned).otherwise(F.col("v")))
    fold = (F.col("claimed") == owner) & (F.col("fold") == 2)
    found = []
    for x in (u, moved):
        dev = N.variant_trials(x).filter((F.col("part") == "dev") & fold)
        found.append({(r.variant, r.rule): r.threshold for r in N.thresholds(dev, ["variant", "claimed", "fold"]).collect()})
    assert found[0] == pytest.approx(found[1]) and len(found[0]) == 15


def test_trimming_drops_the_outlier(spark):
    rows = [(i, 1, i % 3, 0, [1.0, 0.02 * i, 0.0]) for i in range(12)] + [(99, 1, 0, 0, [-1.0, 0.0, 0.3])]
    u = V.unit_vectors(spark.createDataFrame(rows, SCHEMA))
    given = N.templates(u)
    plain = {(r.fold, r.inner): np.array(r.c) for r in given.collect()}
    cut = {(r.fold, r.inner): np.array(r.c) for r in N.trimmed(u, given).collect()}
    assert cut[1, 1][0] > plain[1, 1][0] and cut.keys() == plain.keys()


def test_weights_are_poisson_and_equal_a_plain_reading(spark):
    row = spark.range(1).select(I.weights(4000, 3, F.lit("a"), F.lit(5)).alias("w")).first().w
    assert np.mean(row) == pytest.approx(1, abs=0.06) and np.var(row) == pytest.approx(1, abs=0.12)
    from hashlib import md5

    digits = "".join(md5(f"3|{b}|a|5".encode()).hexdigest() for b in range(500))
    assert row[:50] == [sum(digits[4 * i:4 * i + 4] >= s for s in I.POISSON_STEPS) for i in range(50)]
    for mean in (1, 2, 64, 1024):
        least, steps = I.poisson_steps(mean)
        draws = [least + sum(f"{p:04x}" >= s for s in steps) for p in range(0, 65536, 97)]
        assert np.mean(draws) == pytest.approx(mean, rel=0.02) and np.var(draws) == pytest.approx(mean, rel=0.05)


def test_reported_interval_is_never_narrower_than_wilson(spark):
    rows = [("one", "a", 0, 20), ("few", "a", 1, 10), ("few", "b", 0, 10), ("zero", "a", 0, 30), ("zero", "b", 0, 30)]
    rows += [("many", f"c{i}", 5 if i == 0 else 0, 10) for i in range(8)]
    got = {r.grp: r for r in I.reported_interval(spark.createDataFrame(rows, "grp string, cluster string, k long, n long"), ["grp"], "cluster", 400).collect()}

    def wilson(k, n, z=1.96):
        p, d = k / n, 1 + z * z / n
        mid, half = (p + z * z / (2 * n)) / d, z / d * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return max(0, mid - half), min(1, mid + half)

    assert (got["one"].lo, got["one"].hi, got["one"].informative) == (0, 1, False)
    for g, k, n in (("few", 1, 20), ("zero", 0, 60), ("many", 5, 80)):
        lo, hi = wilson(k, n)
        assert got[g].lo <= lo + 1e-12 and got[g].hi >= hi - 1e-12 and got[g].rate == k / n
    assert got["zero"].hi == pytest.approx(wilson(0, 60)[1]) and not got["zero"].informative and not got["few"].informative
    assert got["many"].informative and got["many"].hi > wilson(5, 80)[1]


def test_newton_fit_is_flat_where_it_ends(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 2, bool(y), float(y + rng.normal(0, 0.6)), None if k % 9 == 0 else float(rng.random()), float(0.5 * y + rng.normal(0, 0.5))) for k, y in enumerate(rng.integers(0, 2, 600))]
    dev = spark.createDataFrame(rows, "grp long, is_genuine boolean, s_voice double, s_graph double, s_know double")
    fit = M.fit_weights(dev, ["grp"]).collect()
    assert len(fit) == 6 and all(abs(r.gradient) < 1e-9 for r in fit)
    for g in (0, 1):
        x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows if r[0] == g])
        y = np.array([r[1] for r in rows if r[0] == g], float)
        x = np.where(np.isnan(x), np.nanmean(x, 0), x)
        w = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
        coef = {r.branch: r.coef for r in fit if r.grp == g}
        c = np.array([coef[b] for b in BRANCHES])

        def loss(b, c, x=x, y=y, w=w):
            z = b + x @ c
            return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (c @ c)

        bs = np.linspace(-5, 5, 4001)
        b = bs[np.argmin([loss(v, c) for v in bs])]
        assert all(loss(b, c + np.eye(3)[i] * d) > loss(b, c) - 1e-4 for i in range(3) for d in (-0.05, 0.05))


def test_eer_interval_equals_plain_resampling_of_the_same_weights(spark):
    rng = np.random.default_rng(1)
    rows = [("g", bool(y), round(float(rng.normal(y)), 1)) for y in rng.integers(0, 2, 500)] + [("g", True, float("-inf"))] * 3 + [("g", False, None)]
    got = I.eer_interval(spark.createDataFrame(rows, "grp string, is_genuine boolean, score double"), ["grp"], 50).first()
    g = np.array([s for _, y, s in rows if y and s is not None])
    i = np.array([s for _, y, s in rows if not y and s is not None])

    def eer(g, i):
        t = np.unique(np.r_[g, i])
        t = t[t > -np.inf]
        far, frr = np.array([(i >= x).mean() for x in t]), np.array([(g < x).mean() for x in t])
        k = int(np.argmax(far <= frr))
        a = (far[k - 1] - frr[k - 1]) / ((far[k - 1] - frr[k - 1]) - (far[k] - frr[k]))
        return far[k - 1] + a * (far[k] - far[k - 1])

    assert got.eer == pytest.approx(eer(g, i)) and got.lo < got.eer < got.hi
    boots = [eer(rng.choice(g, len(g)), rng.choice(i, len(i))) for _ in range(400)]
    assert got.hi - got.lo == pytest.approx(np.quantile(boots, 0.975) - np.quantile(boots, 0.025), rel=0.5)


def test_versioned_table_replays_removes_and_compacts(spark, tmp_path):
    path, schema = str(tmp_path / "facts"), "speaker long, predicate string, value string, at long, removed boolean"
    batches = [[(1, "a", "x", 1, False), (1, "b", "y", 1, False), (2, "a", "z", 1, False)], [(1, "a", None, 5, True), (2, "a", "w", 4, False)], [(1, "b", "late", 0, False), (3, None, "n", 9, False)], [(1, "a", "older", 3, False)]]

    def now():
        return sorted(map(str, ((r.speaker, r.predicate, r.value) for r in versioned.current(spark, path, ["speaker", "predicate"], ["at"]).collect())))

    write = versioned.sink(path)
    for n, rows in enumerate(batches[:3]):
        write(spark.createDataFrame(rows, schema), n)
    want = sorted(map(str, [(1, "b", "y"), (2, "a", "w"), (3, None, "n")]))
    assert now() == want
    write(spark.createDataFrame(batches[1], schema), 1)  # a batch again
    assert now() == want
    assert versioned.compact(spark, path, ["speaker", "predicate"], ["at"]) == 2 and now() == want
    write(spark.createDataFrame(batches[3], schema), 3)  # older than the removal that the base remembers
    assert now() == want
    assert versioned.compact(spark, path, ["speaker", "predicate"], ["at"]) == 3 and versioned.compact(spark, path, ["speaker", "predicate"], ["at"]) == 3 and now() == want


def test_versioned_table_as_a_stream_sink(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "facts")
    for i in range(3):
        spark.createDataFrame([(k, i, i == 2 and k == 0) for k in range(4)], "k long, at long, removed boolean").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, at long, removed boolean").option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(versioned.sink(path)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.k: r.at for r in versioned.current(spark, path, ["k"], ["at"]).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def test_erasure_follows_chains_and_cycles(spark):
    people = spark.createDataFrame([(i, (i + 1) if i in (1, 2) else None) for i in range(1, 8)], "id long, friend long")
    orders = spark.createDataFrame([(10 * p + k, p) for p in range(1, 8) for k in range(3)] + [(999, None)], "oid long, person long")
    items = spark.createDataFrame([(o, n) for p in range(1, 8) for k in range(3) for o in [10 * p + k] for n in range(2)], "oid long, n long")
    tables = {"people": people, "orders": orders, "items": items}
    links = [E.Link("orders", "person", "people", "id"), E.Link("items", "oid", "orders", "oid")]
    gone = spark.createDataFrame([(2,), (3,), (77,)], "id long")
    after = E.erased(tables, links, "people", "id", gone)
    assert {r.id for r in after["people"].collect()} == {1, 4, 5, 6, 7}
    assert after["orders"].count() == 16 and after["items"].count() == 30
    rows = {r.tbl: (r.before_n, r.after_n, r.erased_n, r.residue_n) for r in E.audit(tables, after, links, "people", "id", gone).collect()}
    assert rows == {"people": (7, 5, 2, 0), "orders": (22, 16, 6, 0), "items": (42, 30, 12, 0)}
    kept = E.audit(tables, tables, links, "people", "id", gone)
    assert {r.tbl: r.residue_n for r in kept.collect()}["people"] == 2


def test_digest_tree_sees_every_line_and_the_header(spark):
    lines = spark.createDataFrame([(7, f"m{i % 3}", f"line {i}") for i in range(500)], "seed int, m string, line string")
    of = lambda df, h="h": H.digest_tree(df, "seed", "m", "line", F.lit(h)).first()
    first = of(lines)
    assert first.n == 500 and of(lines.orderBy(F.desc("line"))).digest == first.digest
    changed = lines.withColumn("line", F.when(F.col("line") == "line 17", "line x").otherwise(F.col("line")))
    assert len({first.digest, of(changed).digest, of(lines, "other").digest}) == 3


def test_attacks_move_half_the_way(spark):
    u = with_roles(some_units(spark))
    given = N.templates(u.filter("role = 'enrollee'"))
    a = N.attacks(u.filter("role = 'test'"), given)
    near = N.attack_trials(u).filter("variant = 'baseline'").groupBy("attack").agg(F.avg("score").alias("s")).collect()
    score = {r.attack: r.s for r in near}
    assert score["blend"] > score["stranger"] + 0.3
    assert a.count() == 2 * u.filter("role = 'test'").count() * given.filter(F.col("fold") == F.col("inner")).count()


def test_seeded_roles_do_not_depend_on_row_order(spark):
    rows = [(s, s % 2) for s in range(40)]
    random.Random(1).shuffle(rows)
    one, two = (N.roles(spark.createDataFrame(r, "speaker long, source long"), "source", "speaker") for r in (rows, rows[::-1]))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r.role: r.c for r in one.groupBy("role").agg(F.count("*").alias("c")).collect()} == {"enrollee": 8, "norm": 8, "fit": 8, "test": 16}
