"""The text operators against brute force, SQL and planted cases."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from check import duck
from pyspark.sql import functions as F

import corpus_pipeline
from verilens.llm import decontaminate, gru_lm, html_text, licences, lines, lz_fingerprint, order_minhash, packing, pii, toxicity
from verilens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, at int, key string, comp int"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2) for i, t, s in rows], DOCS)


def prose(seed, n, words=4000):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, words, n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    want = duck(SF).sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want.select(*columns).fetchall()))


ODD = [(None, "Null id.\nA line", None), (1, None, "a"), (2, "", "b"), (3, "  \n \n", "c"), (4, "Same text here for all of us today", "a"), (4, "Same text here for all of us today", "a"), (5, "Same text here for all of us today", "b")]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows_and_empty_tables(spark, rows):
    d = docs(spark, rows)
    n = len(rows)
    items = spark.createDataFrame([(1, "Same text here for all of us today"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert licences.scan(d, licences.known(spark)).count() == n
    assert lines.dedup_lines(d).count() == n
    found = decontaminate.matches(d, items).collect()
    assert sorted((r.doc, r.item, r.similarity) for r in found) == ([(4, 1, 1.0), (5, 1, 1.0)] if n else [])
    assert decontaminate.matches(d, items.limit(0)).count() == 0
    assert toxicity.scored(d, toxicity.fit(spark, d, labels)).filter("is_toxic").count() == 0
    classes = order_minhash.classes(d).collect()
    assert len(classes) == n
    if n:
        assert {r.class_id for r in classes if r.id in (4, 5)} == {4}
        assert {r.class_id for r in classes if r.id in (1, 2)} == {1}  # null counts as empty
    assert order_minhash.keep_one(d).count() == (4 if n else 0)
    pieces = packing.pack(d, packing.vocabulary()).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) >= n
    assert lz_fingerprint.fingerprints(d).count() == n
    assert pii.find(d, pii.train(d)).count() == n
    scores = gru_lm.scores(d).collect()
    assert len(scores) == n and all(np.isfinite(r.score) for r in scores)
    pages = spark.createDataFrame([(i, t) for i, t, _ in rows], "page_id long, html string")
    assert html_text.extract(pages).count() == n


def test_licence_variants(spark):
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and "hereby" in t)
    variant = mit.replace("License", "LICENCE").replace('"', "'").replace(", ", " ,\n ").replace("Copyright (c) 2000 Holder", "Copyright © 1999-2024 Someone Else, Inc.")
    d = docs(spark, [(1, variant, "a"), (2, mit + " And more.", "a"), (3, "text\nlicenced under the Apache Licence, version 2.0\nmore", "a")])
    got = {r.id: (r.licences, r.is_licence) for r in licences.scan(d, licences.known(spark)).collect()}
    assert got == {1: ("MIT", True), 2: ("", False), 3: ("Apache-2.0", False)}


def test_main_text_drops_what_is_around():
    page = """<!DOCTYPE html><body><header class=site><p>Site, name, and more</p></header><div class="top-menu"><a href=a>A</a></div>
    <div class="cookie-notice"><p>We use cookies, many, many, of them.</p></div><main><article><header><h1>T &amp; t</h1><p>By someone</p></header>
    <section><p>First, <b>bold</b>\n text&nbsp;here, and more of it.<p>Second one<br>goes on, &eacute;.</section><aside><p>Aside, text, here</p></aside>
    <form><p>Sign up, now</p></form><script>if (a < b) "</p>"</script></article><div id=comments><article><p>Nice, post, really, nice</p></article></div></main><footer>&copy; x</footer>"""
    assert html_text.main_text(page) == "T & t\nFirst, bold text here, and more of it.\nSecond one goes on, é."
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "<p"
    assert html_text.main_text("<div>" * 3000 + "<p>deep, text" + "</div>" * 3000) == "deep, text"


def test_toxic_documents_on_held_out_labels(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(spark, d, labels.filter(~fold))
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == toxicity.GRADES
    got = toxicity.scored(d, model).join(labels.filter(fold), "doc_id").select("toxic", "is_toxic", "severity", "text").toPandas()
    assert not got[got.toxic == 0].is_toxic.any()
    insult = got.text.str.contains(r"\b(?:idiot|clown|moron|scum|trash|stupid|pathetic|worthless|disgusting|loser)\b", case=False)
    assert got[(got.toxic == 1) & insult].is_toxic.mean() > 0.8


def test_simhash_blocks_find_all_within_radius(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for i in range(30):
        w = list(base)
        for j in rng.integers(0, 40, i % 4):
            w[j] = f"x{i}{j}"
        texts.append((i, " ".join([*prose(i, 30), *w, *prose(90 + i, 20)]), "a"))
    items = spark.createDataFrame([(7, " ".join(base))], "item_id long, text string")
    got = {r.doc: r.similarity for r in decontaminate.matches(docs(spark, texts), items).collect()}

    def best(text):
        sh = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        w, item = text.split(), sh(base)
        out = 0
        for a in range(len(w) - 39):
            own = sh(w[a:a + 40])
            out = max(out, sum((own & item).values()) / sum((own | item).values()))
        return out

    assert got == pytest.approx({i: best(t) for i, t, _ in texts if best(t) >= 0.8})


def test_passages_with_moved_parts_are_found(spark):
    base = [f"b{i}" for i in range(60)]
    for parts in ([base[30:], base[:30]], [base[40:], base[20:40], base[:20]]):
        moved = sum(parts, [])
        sh = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        want = len(sh(moved) & sh(base)) / len(sh(moved) | sh(base))
        texts = [(0, " ".join([*prose(1, 50), *moved, *prose(2, 50)]), "a"), (1, " ".join(moved), "a"), (2, " ".join(base[:30]), "a")]
        items = spark.createDataFrame([(7, " ".join(base))], "item_id long, text string")
        got = {r.doc: (round(r.similarity, 6), r.start_word) for r in decontaminate.matches(docs(spark, texts), items, threshold=0.7).collect()}
        assert got == {0: (round(want, 6), 50), 1: (round(want, 6), 0)}
        if want >= 0.8:
            assert {r.doc for r in decontaminate.matches(docs(spark, texts), items).collect()} == {0, 1}


def test_line_keeps_its_first_place_and_counts_are_exact_near_the_threshold(spark):
    rows = [(i, f"own {i}\nfour sites\n five sites ", f"s{i}") for i in range(4)] + [(9, "five sites\nown 9\n\nfive sites", "s9")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs(spark, rows), min_sites=5).collect()}
    assert got[0] == ("own 0\nfour sites\n five sites ", 3, 0)
    assert got[1] == ("own 1\nfour sites", 3, 1) and got[9] == ("own 9\n", 4, 2)
    many = [(i, "everywhere", f"s{i}") for i in range(300)]
    assert lines.boilerplate(docs(spark, many), 50).count() == 1


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    d = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs(spark, [(9001, "ÀÉ É\x1c I’m<|endoftext|> ok　x 123", "a"), (9002, None, "a")]).select(d.columns)
    texts = {r.doc_id: r.text or "" for r in d.unionByName(extra).collect()}
    pieces = packing.pack(d.unionByName(extra), packing.vocabulary()).toPandas()
    for i, own in pieces.sort_values("start").groupby("id"):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, packing.END], "<u4")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(own.start, own.length)]
    by = pieces.sort_values("offset").groupby("sequence_id")
    assert all(g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] for _, g in by)
    full = by.length.sum()
    assert full.max() <= 2048 and (2048 - full).sum() < 2048


def test_lz_fingerprints_by_brute_force(spark):
    rows = [(i, "".join(np.random.default_rng(i).choice(list("abcé "), 50 + i * 7)), "a") for i in range(12)] + [(50, "", "a"), (51, None, "a"), (None, "tail text", "a")]
    got = {r.id: r for r in lz_fingerprint.fingerprints(docs(spark, rows)).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [r for r in rows if r[0] is None]

    def parse(text):
        seen, now = set(), ""
        for c in text:
            now += c
            if now not in seen:
                seen.add(now)
                now = ""
        return lz_fingerprint.signature(seen)

    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert r.fingerprint == lz_fingerprint._hex(parse(text)) and r.edited_fingerprint == lz_fingerprint._hex(parse(edited))
        assert r.near_edited == pytest.approx((parse(text) == parse(edited)).mean()) and r.near_next == pytest.approx((parse(text) == parse(after)).mean())


def test_lz_parts_meet_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "PART_ROWS", 7)
    rows = [(i, f"text {i} " * (i % 5), "a") for i in range(40)]
    many = sorted(map(tuple, lz_fingerprint.fingerprints(docs(spark, rows)).collect()))
    monkeypatch.setattr(lz_fingerprint, "PART_ROWS", 1000)
    assert many == sorted(map(tuple, lz_fingerprint.fingerprints(docs(spark, rows)).collect()))


def test_near_copies_share_a_class(spark):
    """A hub with edited copies, a chain that only neighbours link, and texts that share a passage but no more."""
    hub, passage, rows = prose(1, 220), prose(2, 60), []
    rng = np.random.default_rng(5)
    for i in range(60):
        w = list(hub)
        for j in rng.integers(0, 220, i % 4):
            w[j] = f"e{i}{j}"
        rows.append((i, " ".join(w), "a"))
    chain = prose(3, 150)
    for i in range(6):
        chain = [*chain[6:], *(f"c{i}{j}" for j in range(6))]
        rows.append((100 + i, " ".join(chain), "a"))
    rows += [(200 + i, " ".join([*passage, *prose(300 + i, 80)]), "a") for i in range(40)]
    h = {i: order_minhash.kmers(t.split()) for i, t, _ in rows}
    root = {i: i for i in h}
    ids = sorted(h)
    for x in ids:
        for y in ids:
            if x < y and order_minhash.likeness(h[x], h[y]) >= 0.8:
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = {r.id: r.class_id for r in order_minhash.classes(docs(spark, rows)).collect()}
    assert got == root and len({got[i] for i in range(200, 240)}) == 40
    assert sorted(r.doc_id for r in order_minhash.keep_one(docs(spark, rows)).collect()) == sorted(set(root.values()))


def test_short_texts_at_the_threshold_share_a_class(spark):
    texts = []
    for i in range(120):
        n = 8 if i < 40 else 12 + i % 17
        w = [f"s{i}x{j}" for j in range(n)]
        texts += [(2 * i, " ".join(w), "a"), (2 * i + 1, " ".join([*w, *(f"e{i}x{j}" for j in range((n - 4) // 4))]), "a")]
    got = {r.id: r.class_id for r in order_minhash.classes(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(240)}


def test_alignment_equals_the_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a = [f"w{x}" for x in rng.integers(0, 12, 40)]
        b = list(a)
        for j in rng.integers(0, len(b), 3):
            b[j] = "z"
        x, y = order_minhash.kmers(a), order_minhash.kmers(b)
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert order_minhash.aligned(x, y, 100) == t[-1, -1]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_are_those_of_the_patterns():
    texts = ["a@b c.d@e.f.g@h.i @x.y a@b..c d@e-.f 1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1111-2 +1 (202) 555-0100. +12 345 +1--------5",
             "x" * 5000 + "@" + "9" * 5000 + ".1.2.3", "+" * 50 + "1 2 3 4 5 6 7 8 9 0 1 2", "é@a.b ü.x@y.zz, 5500005555555559"]
    for text in texts:
        want = []
        for k, (name, pattern) in enumerate(BASE.items()):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m.group().split(".")) if name == "ip" else True,
                      "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
                if ok:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(text) == sorted(want)


def test_labelers_add_obfuscated_spans(spark):
    rows = [(i, f"mail me: user{i}@mail.example.com or call +1 202 555 01{i:02d} now", "a") for i in range(30)]
    rows += [(99, "please mail joe [at] site [dot] com today; phone 202-555-0199, version 1234.1234.1234.1235", "a")]
    got = {r.id: r for r in pii.find(docs(spark, rows), pii.train(docs(spark, rows))).collect()}
    assert got[3].n_email == got[3].n_phone == 1 and got[3].base_sha256 == sha256(got[3].spans.encode()).hexdigest()
    kinds = [x.split(":")[0] for x in got[99].spans.split(",")]
    assert "email" in kinds and "card" not in kinds


def test_gradient_of_the_network():
    p = {k: v.astype(np.float64) for k, v in gru_lm.blank(np.zeros(gru_lm.CLASSES), np.zeros(gru_lm.TOP)).items()}
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, gru_lm.TOP + gru_lm.TAIL, (5, 3)) for _ in range(2))
    first = np.zeros((5, 3), bool)
    first[0] = first[3, 1] = True
    h = np.zeros((3, gru_lm.HIDDEN))
    g, loss, _ = gru_lm.window_gradient(p, x, y, first, h)
    for name in p:
        flat = p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            old = flat[i]
            flat[i] = old + 1e-4
            up = gru_lm.window_gradient(p, x, y, first, h)[1]
            flat[i] = old - 1e-4
            down = gru_lm.window_gradient(p, x, y, first, h)[1]
            flat[i] = old
            assert (up - down) / 2e-4 == pytest.approx(g[name].reshape(-1)[i], rel=2e-2, abs=1e-5)


def test_base_scores_and_gain_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = gru_lm.scores(d).toPandas().set_index("id")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in d.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in [*t, None])
    n, v = sum(c.values()), len(c)
    for i in list(texts)[:60]:
        own = [*texts[i], None]
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(w in c for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    test = got[got.held_out]
    assert test.score.sum() > test.base_score.sum()


def test_every_training_row_is_in_one_round(spark):
    rows = [(i, "A copy that a third of the rows hold" if i % 3 else f"Text {i} of its own") for i in range(300)]
    d = spark.createDataFrame([*rows, (7, None)], "id long, text string")
    rounds = [sorted((r.id, r.text or "") for r in gru_lm.in_round(d, now).collect()) for now in range(gru_lm.ROUNDS)]
    assert sorted(sum(rounds, [])) == sorted([*rows, (7, "")])
    assert all(sum("copy" in text for _, text in r) > 50 for r in rounds)


def test_every_token_of_a_lane_is_trained_on():
    rng = np.random.default_rng(6)
    for sizes in ([1], [1, 40, 7, 300, 2], [3000], [390_001], [5, 250_000, 30_000, 1100]):
        p = gru_lm.blank(np.zeros(gru_lm.CLASSES), np.zeros(gru_lm.TOP))
        texts = [rng.integers(0, gru_lm.TOP + gru_lm.TAIL, n).astype(np.int32) for n in sizes]
        assert gru_lm.train_on(p, iter(texts)) == sum(sizes)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, y = (rng.integers(0, gru_lm.TOP + gru_lm.TAIL, (5, 3)) for _ in range(2))
    first, h, ends = np.zeros((5, 3), bool), np.zeros((3, gru_lm.HIDDEN)), [5, 2, 4]
    g, loss, _ = gru_lm.window_gradient(p, x, y, first, h, np.arange(5)[:, None] < np.array(ends))
    alone = [gru_lm.window_gradient(p, x[:n, [i]], y[:n, [i]], first[:n, [i]], h[[i]]) for i, n in enumerate(ends)]
    assert loss == pytest.approx(sum(a[1] * n for a, n in zip(alone, ends, strict=True)) / 11, rel=1e-5)
    for k in g:
        assert g[k] == pytest.approx(sum(a[0][k] * n for a, n in zip(alone, ends, strict=True)) / 11, rel=1e-3, abs=1e-6)


def test_scores_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    p = gru_lm.blank(np.zeros(gru_lm.CLASSES), np.zeros(gru_lm.TOP))
    texts = [rng.integers(0, gru_lm.TOP + gru_lm.TAIL, n).astype(np.int32) for n in (1, 40, 7, 300, 2)]
    together = gru_lm.score_all(p, texts)
    assert together == pytest.approx([gru_lm.score_all(p, [t])[0] for t in texts], rel=1e-4)


def test_pipeline_stages_do_their_work(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns, name


def test_rows_of_one_id_with_different_texts_all_stay(spark):
    d = docs(spark, [(None, "first text without an id", "a"), (None, "quite another one here", "a"), (7, "a third text of its own", "a"), (7, "and a fourth with that id", "a"), (7, "and a fourth with that id", "b")])
    clash = d.withColumnRenamed("key", "place")
    got = order_minhash.keep_one(clash)
    assert got.columns == clash.columns and sorted(r.text for r in got.collect()) == sorted({r.text for r in d.collect()})


def test_taken_stretches_against_all_spans():
    rng = np.random.default_rng(5)
    for _ in range(300):
        spans = sorted((int(a), 0, int(a + n)) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 9, 6), strict=True))
        a, n = map(int, (rng.integers(0, 60), rng.integers(1, 9)))
        assert pii._overlaps(pii._merged(spans), a, a + n) == any(s < a + n and a < e for s, _, e in spans)
