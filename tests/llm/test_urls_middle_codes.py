"""URL rules, fill-in-middle and part codes against brute force and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verilens.llm import fill_in_middle, part_codes, url_rules

URLS = [
    "http://a.example.org/es/1?x", "HTTP://WWW.Example.ORG/en/192", "https://example.org", "https://example.org?x=/es/", "http://b.com/fr/", "http://b.com/FR/", "http://b.com/de/x#y",
    "http://ads-track.example.net/x", "http://x.ads-track.example.net/about-ads/", "http://my-ads-track.net/", "x://y://z/de/", "nothing", "", None, "://", "http://doubleclick.net:80/",
    "http://notdoubleclick.net/", "http://a.net/BANNER-ads/1", "http://a.net/p?u=http://b.com/de/", "http://s\u0131te.com/de/", "http://example.org\n/en/1", "http://a.com/" + "fr/" * 30_000,
]


def by_hand(url, sites, patterns):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest or "").group()
    low = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    path = re.match(r"[^?#]*", (rest or "")[len(host):]).group()
    fits = [(len(h + p), h, p, v) for h, p, v in sites if (low == h or low.endswith("." + h)) and path.startswith(p)] if rest is not None else []
    if fits:
        _, h, p, v = max(fits)
        return low, path, h + p, v
    hit = [p for p in patterns if rest is not None and matches(p.removeprefix("@@"), low + rest[len(host):])]
    bad = bool(hit) and not any(p.startswith("@@") for p in hit)
    return low, path, None, "block" if bad else "allow"


def matches(pattern, address):
    """A filter-list pattern against an address, by trying every start."""
    anchored, label = pattern.startswith("|"), pattern.startswith("||")
    body = pattern.lstrip("|").lower()
    address = address.lower()
    host = re.match(r"[^/?#]*", address).group()

    def at(i, j):
        if j == len(body):
            return True
        if body[j] == "*":
            return any(at(k, j + 1) for k in range(i, len(address) + 1))
        if body[j] == "^":
            return (i == len(address) and j + 1 == len(body)) or (i < len(address) and not re.match(r"[A-Za-z0-9_.%-]", address[i]) and at(i + 1, j + 1))
        return i < len(address) and address[i] == body[j] and at(i + 1, j + 1)

    starts = [0, *[i + 1 for i, c in enumerate(host) if c == "."]] if label else [0] if anchored else range(len(address) + 1)
    return any(at(i, 0) for i in starts)


def test_url_verdicts(spark):
    rows = [(i, u, "r", 7) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, Token int")
    got = url_rules.judged(pages, url_rules.registered(spark))
    assert got.columns == ["page_id", "url", "rule", "Token", "host", "path", "rule_", "pattern", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule_, r.verdict) == by_hand(r.url, url_rules.SITES, [] if len(r.url or "") > 1000 else url_rules.PATTERNS), r.url
    assert got.count() == len(rows)
    assert url_rules.judged(pages.limit(0), url_rules.registered(spark)).count() == 0


def test_rules_of_every_kind_are_fetched(spark):
    """Rules with no whole token, with wildcards, and none at all; a rule is indexed under its rarest token."""
    rnd = random.Random(5)
    words = ["a", "ab", "b1", "com", "net", "x"]
    urls = ["http://" + ".".join(rnd.choices(words, k=2)) + "".join(rnd.choice("/-?.") + rnd.choice(words) for _ in range(rnd.randint(0, 3))) for _ in range(400)]
    patterns = ["a*b", "||b1.", "|ab.com^", "/x^", "^a^", "@@||x.net/ab", "com/a*x"]
    sites = [("", "/a", "block"), ("com", "", "allow"), ("b1.net", "/ab", "block"), (None, "/", "block"), ("x", None, "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_rules.pattern_rules(spark.createDataFrame([(p,) for p in [*patterns, None, "", "||"]], "pattern string")).unionByName(
        url_rules.site_rules(spark.createDataFrame(sites, "host string, path string, verdict string")))
    plain = [s for s in sites if None not in s]
    for r in url_rules.judged(pages, rules).collect():
        low, path, _, _ = by_hand(r.url, [], [])
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in plain if (h == "" or low == h or low.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[2:] if fits else by_hand(r.url, [], patterns)[2:]
        assert (r.rule, r.verdict) == want, r.url
    assert {r.verdict for r in url_rules.judged(pages, rules.limit(0)).collect()} == {"allow"}
    index = url_rules.indexed(rules, pages.select("url", url_rules.address(F.col("url")).alias("address"))).collect()
    assert len(index) == rules.count()
    assert {r.rule: r.token for r in index}["a*b"] == ""


def fim_by_hand(doc, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rnd = random.Random(2)
    bits = ["a", "é", "\U0001d11e", "<", "P", "S>", "<S", ">", " ", "\n", "\x0b", "\x85", "\u00a0", "word", "<M"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(300)] + [None, "", " ", "  \n", "w" * 100_000, " x" * 200_000]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "null id here", "k")] * 3 + [(7, "same id, other text", "k")] + [(8, "same row", "k")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    for chunk in (1, 4, 512):
        made = fill_in_middle.pieces(d.filter("text IS NULL OR length(text) < 1000") if chunk < 512 else d, chunk=chunk)
        want = sorted(map(str, ((str(i) if i is not None else None, *fim_by_hand(i, t or "")) for i, t, _ in rows if chunk == 512 or len(t or "") < 1000)))
        out = fill_in_middle.outputs(made).collect()
        assert sorted(str((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out) == want
        assert sorted(fill_in_middle.restore(r.output, r.form) for r in out) == sorted((t or "") for _, t, _ in rows if chunk == 512 or len(t or "") < 1000)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        texts_of = {sha(fim_by_hand(i, t or "")[-1]): sha(t or "") for i, t, _ in rows}
        digests = fill_in_middle.digested(made).collect()
        assert sorted(r.output_sha256 for r in digests) == sorted(sha(r.output) for r in out)
        assert all(texts_of[r.output_sha256] == r.restored_sha256 for r in digests)
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    assert fill_in_middle.digested(fill_in_middle.pieces(d.limit(0))).count() == 0


def test_fill_in_middle_sorts_without_a_second_shuffle(spark):
    plan = fill_in_middle.digested(fill_in_middle.pieces(spark.range(3).selectExpr("id AS doc_id", "'a b c' AS text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def codes_by_hand(x, parts, entries, rounds):
    """Codes, errors and codebooks from all distances, for rows in the order of their ids."""
    v = x.reshape(len(x), parts, -1)
    book = v[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = np.square(v[:, :, None, :] - book[None]).sum(3)
        code, error = d.argmin(2), d.min(2).sum(1)
        if r < rounds:
            for p in range(parts):
                for k in range(book.shape[1]):
                    own = v[code[:, p] == k, p]
                    if len(own):
                        book[p, k] = own.sum(0) // len(own)
    return code, error, book


@pytest.mark.parametrize("case", ["spread", "ties", "copies", "far"])
def test_part_codes(spark, case, monkeypatch):
    monkeypatch.setattr(part_codes, "BLOCK", 300)
    monkeypatch.setattr(part_codes, "LEAF", 10)
    rng = np.random.default_rng(4)
    x = {"spread": rng.normal(size=(900, 32)), "ties": rng.integers(-2, 3, (900, 32)) / 256, "copies": np.repeat(rng.normal(size=(9, 32)), 100, 0),
         "far": rng.normal(size=(900, 32)) * 10.0 ** rng.integers(-3, 9, (900, 1))}[case]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), i % 3 or None, "a") for i, v in enumerate(x)]
    odd = [(2000, None, 1, "b"), (2001, [1.0, None] * 16, 1, "b"), (2002, [float("nan")] * 32, 1, "b"), (2003, [float("inf")] * 32, 1, "b"), (2004, [1.0] * 8, 1, "b")]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])
    codes, book = part_codes.compressed(spark.createDataFrame(rows + odd, schema), parts=8, entries=20)
    got = {r.vec_id: r for r in part_codes.with_label_errors(codes).collect()}
    whole = np.clip(np.floor(x.astype(np.float64) * 256), -part_codes.LARGEST, part_codes.LARGEST).astype(np.int64)
    code, error, want = codes_by_hand(whole, 8, 20, 2)
    assert (book == want).all()
    assert [got[i].code for i in range(len(x))] == [bytes(c.tolist()).hex() for c in code]
    assert [got[i].error for i in range(len(x))] == error.tolist()
    assert {got[i].label_error for i in range(0, len(x), 3)} == {int(error[::3].sum())}
    assert set(got) - set(range(len(x))) == {2004} and got[2004].code is None


def test_part_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty, book = part_codes.compressed(spark.createDataFrame([], schema))
    assert part_codes.with_label_errors(empty).count() == 0 and book.size == 0
    rows = [(None, [1.0] * 16, None), (None, [1.0] * 16, None), (5, [0.5] * 16, 1), (5, [2.0] * 16, 1), (6, [], 1)]
    codes, book = part_codes.compressed(spark.createDataFrame(rows, schema))
    assert book.shape == (16, 1, 1)
    # one entry, at the floor of the mean of 256, 256, 128 and 512
    assert sorted(r.error for r in codes.filter("code IS NOT NULL").collect()) == [16 * d * d for d in (32, 32, 160, 224)]
    assert codes.count() == 5 and codes.filter("code IS NULL").count() == 1
    none, book = part_codes.compressed(spark.createDataFrame([(1, [1.0] * 15, 1)], schema))
    assert none.first().code is None and book.size == 0


def test_trees_decide_whole_balls():
    """Tight clusters are owned without a look at their points, and radii cover them."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (20, 4))
    x = (centres[rng.integers(0, 20, 5000)] + rng.integers(-3, 4, (5000, 4))).astype(np.int64)
    order, nodes = part_codes.tree(x)
    assert sorted(order.tolist()) == list(range(5000))
    x = x[order]
    centre, radius, total = part_codes.balls(x, nodes)
    for (a, b, left, right), c, r, t in zip(nodes, centre, radius, total, strict=True):
        assert np.sqrt(np.square(x[a:b] - c.astype(np.float64)).sum(1).max()) <= r and (x[a:b].sum(0) == t).all()
        assert left < 0 or (nodes[left][0] == a and nodes[left][1] == nodes[right][0] and nodes[right][1] == b)
    owned, points, _ = part_codes._walk(x, nodes, centre, radius, centres.astype(np.int64))
    assert sum((nodes[at, 1] - nodes[at, 0]).sum() for at, _ in owned) + len(points) == 5000
    assert len(points) < 500
