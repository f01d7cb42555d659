"""Broken pages, clashing names, repeated rows, and what each stage of the pipeline takes away."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verilens.llm import decontaminate, html_text, licences, lines, packing, toxicity

CLASH = ["severity", "Chance", "is_toxic", "N_removed", "n_lines", "main_text", "scored"]


def clashing(spark, rows):
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.mark.parametrize("page", ["<a" * 500_000, "<" + "a" * 1_000_000, "<a '" * 250_000, "<a \">\" " * 100_000 + "\"", "<!" * 500_000, "<script>" + "</script " * 100_000,
                                  "<p><div>" + "<span>" * 100_000 + "x</p>" * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<a " + "b=' " * 250_000 + ">x"],
                         ids=["tags", "name", "quote", "quoted", "declarations", "script", "spans", "bold", "attributes"])
def test_broken_pages_end_in_seconds(page):
    start = time.perf_counter()
    html_text.main_text(page)
    html_text.main_text("<p>Text, and more.</p>" + page)
    assert time.perf_counter() - start < 30


def test_broken_pages_are_read_on():
    assert html_text.main_text("<p>One, two</p><a href='x") == "One, two\n<a href='x"
    assert html_text.main_text("<p>One, <b title='a>b'>two</b></p><!-- never <p>closed</p>") == "One, two"
    assert html_text.main_text("<p>a < b, <3</p>") == "a < b, <3"


def test_names_that_the_operators_use(spark):
    rows = [(1, "a\nshared line\nb", "s1"), (2, "shared line\nc", "s2"), (3, "d\nshared line", "s3"), (3, "d\nshared line", "s3"), (4, None, None)]
    d = clashing(spark, rows)
    model = toxicity.Ordinal(["=shared"], np.array([9.0]), np.array([3.0, 4.0, 5.0]))
    made = toxicity.scored(d, model)
    assert made.columns == [*d.columns, "severity_", "chance_", "is_toxic_"]
    assert {r.doc_id for r in made.filter("is_toxic_").collect()} == {1, 2, 3} and {r.severity for r in made.collect()} == {"own severity"}
    assert toxicity.clean(d, model).columns == d.columns and toxicity.clean(d, model).count() == 1
    assert lines.dedup_lines(d, 3).columns == [*d.columns, "n_lines_", "n_removed_"]
    got = lines.without_boilerplate(d, min_sites=3)
    assert got.columns == d.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == sorted([(1, "a\nshared line\nb", 15), (2, "c", 1), (3, "d", 1), (3, "d", 1), (4, None, 0)])
    assert html_text.extract(d, "text").columns == [*d.columns, "main_text_"]


def test_rows_that_repeat_find_a_licence_once(spark):
    text = "code\nSPDX-License-Identifier: MIT\nmore"
    d = spark.createDataFrame([(1, text), (1, text), (1, "nothing"), (None, text), (None, text)], "doc_id long, text string")
    assert sorted((str(r.id), r.licences, r.n_found) for r in licences.scan(d, licences.known(spark)).collect()) == [
        ("1", "", 0), ("1", "MIT", 1), ("1", "MIT", 1), ("None", "MIT", 1), ("None", "MIT", 1)]


def test_encoder_equals_the_tokenizer():
    encode = packing.Encoder(packing.vocabulary())
    rnd = random.Random(3)
    bits = ["a", "É", "é", "'S", "'s", "'", "9", "²", "½", "İ", "Σ", "ſ", "ǅ", "́", "中", "\U0001d400", "…", "--", " ", "\xa0", "\x85", "\n", "word", "don't", "ŉ", "ª", "_", "’s", "ß", "<|endoftext|>", "<|"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(5000)] + ["", " ", "w" * 50_000]
    assert encode(texts) == encode._raw(texts)


def test_equal_rows_are_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CHARS", 400)
    d = spark.createDataFrame([(1, "the same words here")] * 200, "doc_id long, text string")
    pieces = packing.pack(d, packing.vocabulary()).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and len({r.sequence_id >> 32 for r in pieces}) > 3


def test_assign_takes_the_lowest_cost_with_room():
    rnd = random.Random(7)
    for _ in range(50):
        sizes = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(1, 40))), reverse=True)
        got = packing.assign(sizes, 64)
        room, costs, want = {}, {}, []
        n = -(-sum(sizes) // 64)
        for doc, size in enumerate(sizes):
            start = 0
            while size:
                fits = [k for k in range(n) if room.get(k, 64) >= size]
                to = min(fits, key=lambda k: (costs.get(k, 0.0), k)) if fits else max(range(n), key=lambda k: (room.get(k, 64), -k))
                length = min(size, room.get(to, 64))
                want.append((doc, start, length, to))
                room[to], costs[to] = room.get(to, 64) - length, costs.get(to, 0.0) + packing.cost(length)
                start, size = start + length, size - length
        assert got == want


def test_ordinal_gradient_points_up():
    """The fit ends where the penalised likelihood is flat, by differences."""
    rng = np.random.default_rng(0)
    n, f = 300, 4
    x = rng.integers(0, 3, (n, f)).astype(float)
    grade = np.clip((x @ [0.8, -0.5, 0.3, 0.0] + rng.logistic(size=n)).round(), 0, 3).astype(int)
    sizes, column, value = np.full(n, f), np.tile(np.arange(f), n), x.reshape(-1)
    fit = toxicity.Ordinal.fit([str(i) for i in range(f)], sizes, column, value, grade, steps=3000)

    def loss(w, cuts):
        c = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(cuts[None] - (x @ w)[:, None])), np.zeros((n, 1))], 1)
        return -np.log(np.maximum(c[np.arange(n), grade] - c[np.arange(n), grade + 1], 1e-12)).mean() + 0.5 * 1e-4 * (w * w).sum()

    best = loss(fit.weights, fit.cuts)
    for i in range(f + len(fit.cuts)):
        for step in (-0.02, 0.02):
            w, c = fit.weights.copy(), fit.cuts.copy()
            (w if i < f else c)[i if i < f else i - f] += step
            assert loss(w, c) > best - 1e-6


def test_stages_take_away_what_they_should(spark):
    """Each stage of the pipeline against plain Python on a small corpus."""
    rng = random.Random(11)
    prose = lambda n, s: " ".join(random.Random(s).choices([f"word{i}" for i in range(3000)], k=n))
    item = prose(40, "item")
    texts = [(i, prose(60, i) + "\nread more on our site", f"site{i % 7}") for i in range(20)]
    texts += [(30, texts[3][1], "site9"), (31, texts[4][1].replace("word1 ", "word2 ", 1), "site8"), (40, prose(20, "a") + " " + item + " " + prose(20, "b"), "site1"), (50, "", None), (51, None, None)]
    rng.shuffle(texts)
    d = clashing(spark, texts)
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, d, "").collect()}
    assert {i for i, t in kept.items() if t and "read more" in t} == {0} and len(kept) == len(texts)
    once = corpus_pipeline.keep_one(spark, d, "")
    ids = {r.doc_id for r in once.collect()}
    assert once.columns == d.columns and {3, 4} <= ids and not {30, 31} & ids and len({50, 51} & ids) == 1 and set(range(20)) <= ids
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.clean(d, items)
    assert clean.columns == d.columns and {r.doc_id for r in d.collect()} - {r.doc_id for r in clean.collect()} == {40}
    pieces = corpus_pipeline.packed(spark, d, "").collect()
    assert {r.doc_id for r in pieces} == {i for i, _, _ in texts}
