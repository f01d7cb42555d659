"""What the findings of round 3 changed."""

import numpy as np
from pyspark.sql import functions as F

from verilens.operators import vectors as V


def test_cohort_search_makes_no_row_for_a_pair(spark, monkeypatch):
    """Best cohort scores by tiles of both sides, the same as by brute force, equal for equal vectors."""
    monkeypatch.setattr(V, "TILE_ITEMS", 100)
    monkeypatch.setattr(V, "TILE_COHORT", 60)
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(300, 8)), rng.normal(size=(150, 8))
    items = spark.createDataFrame([(i, x[i % 250].tolist()) for i in range(300)] + [(900, None)], "vec_id long, v array<double>")
    cohort = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, v array<double>")
    top = V.top_k_stats(items, cohort, ["vec_id"], 20, "v")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan
    got = {r.vec_id: (r.mu, r.sd) for r in top.collect()}
    best = np.sort(x @ c.T, axis=1)[:, -20:]
    assert len(got) == 301 and got[900] == (None, None)
    assert all(abs(got[i][0] - best[i % 250].mean()) < 1e-12 and abs(got[i][1] - best[i % 250].std() - 1e-6) < 1e-12 for i in range(300))
    assert all(got[i] == got[i + 250] for i in range(50))
    assert V.top_k_stats(items, cohort.limit(0), ["vec_id"], 20, "v").count() == 0


def test_cohort_scan_names_the_table_and_drops_unknown_speakers(spark, tmp_path):
    """a table of several files has one source; NOT IN keeps no NULL."""
    from verilens.plans.catalog import QUERIES

    rows = spark.createDataFrame([(i, i % 9 if i % 10 else None, [0.5] * 4) for i in range(60)], "vec_id long, label int, embedding array<float>")
    rows.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.source, r.speaker): r.n for r in QUERIES["cohort_scan"](spark, str(tmp_path)).collect()}
    want = {}
    for i in range(60):
        if i % 10 and i % 9 not in (0, 7):
            want["embeddings", i % 9] = want.get(("embeddings", i % 9), 0) + 1
    assert got == want


def test_latin_fraction_says_which_texts_are_comparable(spark):
    """the comparison with the mean of all texts is back in the query."""
    from check import compare, duck

    from verilens.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    assert "comparable" in QUERIES["latin_fraction"](spark, sf).columns
    assert compare(spark, duck(sf), "latin_fraction", sf)[0] == "ok"


def test_each_replicate_of_the_cluster_bootstrap_has_a_digest_of_its_own(spark):
    """weights from 32 bits a replicate, without the cap that 16 bits set."""
    from hashlib import md5


    from verilens.operators import intervals as I

    got = spark.createDataFrame([("R", 5), ("A", 17)], "d string, s long").select("d", "s", I.fine_weights(50, 7, F.col("d"), F.col("s")).alias("w")).collect()
    for r in got:
        u = [(int(md5(f"7|{rep}|{r.d}|{r.s}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for rep in range(1, 51)]
        assert r.w == [sum(x >= p for p in I.POISSON1) for x in u]
    assert len(I.POISSON1) > len(I.POISSON_STEPS) and 1 - I.POISSON1[-1] < 2.0**-30


def test_near_dedup_remembers_few_words_and_finds_the_same():
    """Pipeline: a worker's memory of words is small, and forgetting them changes no k-mer and no key."""
    from verilens.llm import order_minhash as O

    words = [f"word{i}" for i in range(3 * O.REMEMBERED)]
    first = O.kmers(words[:2000])
    O.kmers(words)
    assert len(O._hashes) <= O.REMEMBERED <= 50_000
    assert (O.kmers(words[:2000]) == first).all() and (O.keys(O.kmers(words[:2000])) == O.keys(first)).all()


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


ODD = [None, "", " ", "a", "Élan vital -- x'y z-a 9a _b", "İstanbul ʻokina 漢字 Ⓐ ⓐ 𝒜bc ßa", "b" * 30 + " !? oo ee OO", "-a 'b a-'b c--d", "1 2 3", "Aa bb Aa aa bb"]


def test_choice_words_count_as_token_arrays_do(spark, tmp_path):
    """Labels as one string give the cells and runs that arrays of structs give."""
    from verilens.operators import graph as G
    from verilens.operators import tokens as T
    from verilens.sources import views

    sf = _documents(spark, tmp_path, [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(ODD * 2)])
    old, new = T.choice_arrays(views.token_arrays(spark, sf)), views.choice_words(spark, sf)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(G.cells(old, ["utt"])) == rows(G.word_cells(new, ["utt"]))
    drop = lambda df: df.select(*[F.col(c).cast("long") if c != "speaker" and c != "doc_lang" else F.col(c) for c in df.columns])
    assert rows(drop(T.utterance_stats(old))) == rows(drop(T.sequence_stats(new)))
    assert rows(views.tokens(spark, sf)) == rows(views.token_arrays(spark, sf).select("utt", "speaker", "session", "prompt", "doc_lang", F.inline("toks")))


def test_documents_are_tokenised_once(spark):
    """a table that a query reads twice is kept, not made anew."""
    from verilens.plans.catalog import QUERIES
    from verilens.session import release

    for name in ("discriminative_topk", "share_collapse_audit", "corpus_profile", "graph_jsd"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan, name
        release(spark)


def test_words_are_counted_before_they_meet_the_lexicon(spark):
    """The join takes a row a speaker and word, not a row a token."""
    from verilens.plans import corpus
    from verilens.sources import views

    sf = "/root/testdata/sf0.001"
    m = corpus.merged(spark, sf)
    tokens = views.tokens(spark, sf).filter("lang in ('A', 'B')").count()
    assert m.count() < tokens and m.agg(F.sum("n")).first()[0] == tokens


def test_gold_is_made_from_texts_and_no_token_is_shuffled(spark, tmp_path):
    """the join carries texts; the rows are as before for odd texts too."""
    from verilens.plans import corpus
    from verilens.plans.catalog import QUERIES

    sf = _documents(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in enumerate([*ODD, " ".join(f"w{i}" for i in range(40))] * 2)])
    spark.createDataFrame([(i, 1) for i in (1, 3, 4, 5, 6, 7, 10, 15, 21)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    got = {r.utt: r for r in QUERIES["gold_align"](spark, sf).collect()}
    assert got[5].misaligned and got[10].n == 40 and got[10].n_blank == 4 and got[10].misaligned and not got[6].misaligned and 1 not in got
    out = [(r.idx, r.token, r.prefilled) for r in QUERIES["gold_export"](spark, sf).filter("utt = 21").orderBy("idx").collect()]
    assert out == [(i + 1, f"w{i}", None if (i + 1) % 9 == 0 else "B") for i in range(40)]
    assert not hasattr(corpus, "gold_packed")


def test_only_pairs_within_the_distance_reach_python(spark):
    """F16: the bound in edits loses no pair that difflib takes, and the built-in distance stands before Python."""
    import difflib
    import random

    from verilens.operators import matching as K

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 12)))
    rows = [(i, [word() for _ in range(3)], [word() for _ in range(60)]) for i in range(40)]
    for _, e, h in rows:
        h += [w[:3] + w[4:] for w in e] + [w + "a" for w in e]
    out = K.with_close_words(spark.createDataFrame(rows, "utt long, expected array<string>, heard array<string>"), "utt")
    got = {r.utt: {h: set(ws) for h, ws in r.close.items()} for r in out.collect()}
    for i, e, h in rows:
        want = {}
        for x in set(h):
            near = {w for w in e if w != x and 2 * min(len(w), len(x)) / (len(w) + len(x)) >= 0.8 and difflib.SequenceMatcher(None, w, x).ratio() >= 0.8}
            if near:
                want[x] = near
        assert got[i] == want
    assert "levenshtein" in out._jdf.queryExecution().optimizedPlan().toString()


def test_rules_run_once_a_spelling(spark):
    """the labels are computed for distinct spellings, and each part of a token once."""
    from verilens.functions import text as X
    from verilens.plans.catalog import QUERIES

    one = spark.range(1).select(X.rule_cascade(F.lit("x")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert one.lower().count("regexp_count") <= 3
    assert "InMemoryRelation" in QUERIES["resolution_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_contributions_look_a_class_up_once(spark):
    """one lookup of a class's counts, not one for each use."""
    from verilens.plans.catalog import QUERIES

    plan = QUERIES["llr_contributions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_element_at(cells") <= 2 and "array_sort" not in plan


def test_draws_by_search_are_the_steps_below_the_piece(spark):
    """the draws of ``eer_bootstrap`` by binary search, the same numbers as by counting steps."""
    from verilens.operators import intervals as I

    df = spark.range(40).select((F.col("id") % len(I.MEANS)).cast("int").alias("p"), F.col("id").cast("string").alias("k"))
    rows = df.select("p", I.pieces(50, 3, F.col("k")).alias("u"), I.poisson_draws(50)("p", I.digests(50, 3, F.col("k"))).alias("d")).collect()
    for r in rows:
        least, steps = I.poisson_steps(I.MEANS[r.p])
        assert r.d == [least + sum(s <= u for s in steps) for u in r.u]


def test_language_model_sorts_by_digits():
    """op10_gru_lm: places are sorted as small numbers, in the same order."""
    import inspect

    from verilens.llm import gru_lm as G

    assert "argsort(group.astype(np.uint8)" in inspect.getsource(G.output) and G.CLASSES <= 256 and G.TOP + G.TAIL < 1 << 16


def test_packing_encodes_small_slices():
    """Pipeline: a worker of packing encodes some 4 MB of text at a time, and every row is in one slice."""
    import pyarrow as pa

    from verilens.llm import packing as P

    texts = ["x" * 900_000] * 11 + ["y" * 6_000_000, "", "z"]
    parts = list(P._slices(pa.record_batch([pa.array(range(14)), pa.array([0] * 14), pa.array(texts)], ["id", "grp", "text"])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(14))
    assert all(p.num_rows == 1 or sum(map(len, p.column(2).to_pylist())) <= 4_000_000 for p in parts)


def test_packing_remembers_few_words_and_gives_the_same_ids(monkeypatch):
    """Pipeline: a worker of packing takes 2 MB of text at a time and remembers 400,000 chunks; ids and ends are those of the tokenizer, also when words are forgotten."""
    import pyarrow as pa

    from verilens.llm import packing as P

    assert P.SLICE <= 2_000_000 and P.REMEMBERED <= 400_000
    monkeypatch.setattr(P, "REMEMBERED", 50)
    encode = P.Encoder(P.vocabulary())
    texts = ["", " ", *["".join(f"w{i}, (x{j})  Élan's ß{i} " for j in range(9)) for i in range(40)], "a <|b|> c", "漢字 ⒶⒷ"]
    for _ in range(2):
        ids, ends = encode.flat(pa.array(texts))
        want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
        assert [x.tolist() for x in encode.flat(pa.array(["", ""]))] == [[], [0, 0, 0]] and [x.tolist() for x in encode.flat(pa.array([], pa.string()))] == [[], [0]]


def test_a_tile_of_the_cohort_search_keeps_only_the_best_scores(monkeypatch):
    """A task holds some scores of its tile at a time, not all of them until the tile is done."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(V, "TILE_SCORES", 1 << 18)
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(2100, 8)), rng.normal(size=(3001, 8))
    items, cohort = pa.table({"vec_id": np.arange(2100), "v": x.tolist()}), pa.table({"_cv": c.tolist()})
    tile = V._best(20, ["vec_id"], "v")
    tracemalloc.start()
    try:
        out = tile(items, cohort)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12e6 < x.shape[0] * c.shape[0] * 8
    assert np.allclose(np.sort(out["_top"].to_pylist(), axis=1), np.sort(x @ c.T, axis=1)[:, -20:])
