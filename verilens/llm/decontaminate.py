"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Similarity of a window and an item is that of their bags of five-word
shingles: the sum of the smaller counts over the sum of the larger ones. That
sum of larger ones is at least the number of the item's shingles, so a window
at or over the threshold has the item's shingles at ``threshold`` times that
many of its places, in any order: every window with so many is fingerprinted,
wherever it starts. Fingerprints
are 64-bit SimHashes of the window's words. Both fingerprints are cut into
``blocks`` blocks; two fingerprints within ``radius`` bits differ by at most
``radius // blocks`` bits in some block, and each item is indexed under all
such block values, so every pair within the radius meets. Pairs that meet are
verified exactly.

Defined cases: null or empty texts and items match nothing; an item of fewer
than five words has one shingle, all its words; a text shorter than an item
is compared as far as it reaches; null ids are ids like others; rows that agree in id and
text are one; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.functions.arrays import compute_once, let
from verilens.llm.common import stored, words_sql

SHINGLE = 5
#: A table of up to so many bytes is broadcast, a larger one is joined by shuffle: every executor and the driver hold what is broadcast.
BROADCAST_BYTES = 64_000_000
#: A row's share of a broadcast table besides its arrays: key, pointers and fields.
ROW_BYTES = 160
#: So many windows of a document are cut out at a time.
PART = 64


def _fits(df: DataFrame, more: Column | None = None) -> bool:
    """Whether ``df`` may be broadcast; ``more`` is the bytes of a row's arrays."""
    return (df.agg(F.sum(F.lit(ROW_BYTES).cast("long") if more is None else ROW_BYTES + more)).first()[0] or 0) <= BROADCAST_BYTES


def _small(df: DataFrame, more: Column | None = None) -> DataFrame:
    return F.broadcast(df) if _fits(df, more) else df


def _shingles(words: str, k: int) -> str:
    """SQL for the hashes of all runs of k words."""
    at = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"CASE WHEN size({words}) < {k} THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size({words}) - {k}), i -> xxhash64({at})) END"


def simhash(words: str) -> str:
    """SQL for the 64-bit SimHash of an array of word hashes: bit b is set if most of the hashes have it set."""
    ones = f"aggregate({words}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1 AS int))"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({words}), shiftleft(1L, b), 0L))"


def similarity(a: Column, b: Column) -> Column:
    """Of two bags: the sum of smaller counts over the sum of larger ones."""
    n_a, n_b = F.size(a), F.size(b)
    sets = (F.size(F.array_distinct(a)) == n_a) & (F.size(F.array_distinct(b)) == n_b)
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    bags = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))
    common = F.when(sets, F.size(F.array_intersect(a, b))).otherwise(bags)
    return F.when(n_a + n_b - common > 0, common / (n_a + n_b - common)).otherwise(F.lit(0.0))


def _from_to(a: Column, b: Column) -> Column:
    """All whole numbers from a to b, none if b is less."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block of 64 bits."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _blocks(fingerprint: Column, cuts: list[tuple[int, int]]) -> list[Column]:
    return [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in cuts]


def _entries(block: int, value: Column, masks: list[int]) -> Column:
    """Every value that a fingerprint near enough can have in this block."""
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))


def _met(plain: DataFrame, windows: DataFrame) -> DataFrame:
    """The texts that have windows, with these."""
    same = F.col("x.doc").eqNullSafe(F.col("t.doc")) & (F.col("x.digest") == F.xxhash64("t.text"))
    arrays = F.aggregate("spots", F.lit(0).cast("long"), lambda n, x: n + 40 + 4 * F.size(x["starts"]))
    if _fits(windows, arrays):
        windows = F.broadcast(windows)
    else:
        # Both sides are shuffled: of the texts, only those with the digest of one that has windows, if these digests are few.
        digests = windows.select("digest").distinct()
        if _fits(digests):
            plain = plain.alias("t").join(F.broadcast(digests).alias("d"), F.col("d.digest") == F.xxhash64("t.text"), "left_semi")
        windows = windows.hint("merge")
    return plain.alias("t").join(windows.alias("x"), same).select("x.doc", "x.digest", "x.n", "x.spots", "t.text")


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 16, blocks: int = 6,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, digest, item, similarity, start_word, n_words): the best window of each pair of document and item at or over the threshold.

    ``digest`` is xxhash64 of the text, which with the id names the row; of
    equally good windows the first counts.
    """
    near, cuts = radius // blocks, _cuts(blocks)
    bench = items.select(F.col(item_col).alias("item"), F.expr(words_sql(f"`{item_text}`")).alias("w")).filter("size(w) > 0").distinct()
    bench = bench.select("item", "w", F.size("w").alias("s"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    kinds = sorted(r.k for r in bench.select("k").distinct().collect())  # at most five lengths
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("digest"), F.expr(words_sql(f"`{text_col}`")).alias("w"))
    if not kinds:
        kinds = [SHINGLE]
    made = lambda df, k: F.expr(_shingles("w", k))

    spots, shingled = None, None
    for k in kinds:
        own = bench.filter(F.col("k") == k).withColumn("sh", made(bench, k))
        index = own.select("s", F.explode("sh").alias("h")).distinct()
        seeds = text.select("doc", "digest", F.size("w").alias("n"), F.posexplode(made(text, k)).alias("p", "h")).join(_small(index), "h")
        seeds = seeds.groupBy("doc", "digest", "n", "s").agg(F.lit(k).alias("k"), F.collect_set("p").alias("ps"))
        spots = seeds if spots is None else spots.unionByName(seeds)
        shingled = own if shingled is None else shingled.unionByName(own)

    # ``least`` shared places next to each other, from the i-th on, fit into a window of s words that starts at one of these
    least = F.ceil((F.col("s") - F.col("k") + 1) * threshold - 1e-9).cast("int")
    spots = spots.withColumn("least", least).filter(F.size("ps") >= F.col("least"))
    # (what the place before gives is left out: so the starts are ascending, without repeats, and no more than the words).
    first = lambda ps, i: F.greatest(F.get(ps, i + F.col("least") - 1) - F.col("s") + F.col("k"), F.get(ps, i - 1) + 1)
    runs = lambda ps: F.flatten(F.transform(F.sequence(F.lit(0), F.size(ps) - F.col("least")), lambda i: _from_to(first(ps, i), F.get(ps, i))))
    long_enough = lambda v: F.least(v + F.col("s"), F.col("n")) - F.greatest(v, F.lit(0)) >= F.col("k")
    spots = compute_once(spots, ["doc", "digest", "n", "s", "k"], starts=let(F.array_sort("ps"), lambda ps: F.filter(runs(ps), long_enough)))
    windows = spots.filter(F.size("starts") > 0).groupBy("doc", "digest", "n").agg(F.collect_list(F.struct("s", "k", "starts")).alias("spots"))
    windows = stored(windows, "windows")

    # Plain texts meet the windows, and are cut into words after that: most texts have no window.
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    at = _met(plain, windows)
    hashes = {"all_h": F.transform("all_w", lambda v: F.xxhash64(v))} | {f"sh{k}": F.expr(_shingles("all_w", k)) for k in kinds}
    at = compute_once(at, ["doc", "digest", "n", "spots"], all_w=F.expr(words_sql("text")))
    at = compute_once(at, ["doc", "digest", "n", "spots"], **hashes)
    # A part is cut out at a time: a document's words go into a row once for a part, not once for a window.
    parts = F.flatten(F.transform("spots", lambda x: F.transform(
        F.sequence(F.lit(0), F.size(x["starts"]) - 1, F.lit(PART)), lambda i: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.slice(x["starts"], i + 1, PART).alias("starts")))))
    at = at.select("doc", "digest", "n", *hashes, F.explode(parts).alias("x"))

    def cut(start: Column) -> Column:
        a, b, sh = F.greatest(start, F.lit(0)), F.least(start + F.col("x.s"), F.col("n")), None
        for k in kinds:
            own = F.slice(f"sh{k}", a + 1, b - a - k + 1)
            sh = F.when(F.col("x.k") == k, own) if sh is None else sh.when(F.col("x.k") == k, own)
        return F.struct(a.alias("a"), b.alias("b"), sh.alias("sh"), F.slice("all_h", a + 1, b - a).alias("wh"))

    at = at.select("doc", "digest", F.col("x.s").alias("s"), F.inline(F.transform("x.starts", cut)))
    at = at.select("doc", "digest", "s", "a", "b", "sh", F.expr(simhash("wh")).alias("print"))

    masks = {w: [sum(1 << i for i in c) for n in range(near + 1) for c in combinations(range(w), n)] for w in {w for _, w in cuts}}
    keyed = shingled.withColumn("wh", F.transform("w", lambda v: F.xxhash64(v)))
    keyed = keyed.select("item", "s", F.col("sh").alias("item_sh"), F.expr(simhash("wh")).alias("item_print"))
    entries = F.concat(*[
        _entries(i, v, masks[w]) for i, ((_, w), v) in enumerate(zip(cuts, _blocks(F.col("item_print"), cuts), strict=True))
    ])
    index = keyed.select("item", "s", "item_print", F.explode(entries).alias("e")).select("item", "s", "item_print", "e.*")
    probes = F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_blocks(F.col("print"), cuts))])
    met = (
        at.withColumn("e", F.explode(probes)).select("doc", "digest", "s", "a", "b", "sh", "print", "e.*")
        .join(_small(index), ["s", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    )
    # A pair meets in several blocks: it is taken in the first block that lets it.
    first = F.array_position(F.array(*[
        F.bit_count(a.bitwiseXOR(b)) <= near for a, b in zip(_blocks(F.col("print"), cuts), _blocks(F.col("item_print"), cuts), strict=True)]), True)
    met = met.filter(F.col("block") == first - 1).select("doc", "digest", "item", "s", "a", "b", "sh")
    found = met.join(_small(keyed.select("item", "s", "item_sh"), 8 * F.size("item_sh")).alias("i"), met["item"].eqNullSafe(F.col("i.item")) & (met["s"] == F.col("i.s")))
    found = found.select("doc", "digest", met["item"], "a", "b", similarity(F.col("sh"), F.col("item_sh")).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = found.groupBy("doc", "digest", "item").agg(F.max(F.struct("similarity", (-F.col("a")).alias("neg"), F.col("b"))).alias("m"))
    return best.select("doc", "digest", "item", F.col("m.similarity").alias("similarity"), (-F.col("m.neg")).cast("long").alias("start_word"), (F.col("m.b") + F.col("m.neg")).cast("long").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no passage like a benchmark item, with all their columns."""
    bad = matches(docs, items, threshold, id_col=id_col, text_col=text_col).select(F.col("doc").alias("bad_doc"), F.col("digest").alias("bad_digest")).distinct()
    d = docs.alias("d")
    return d.join(_small(stored(bad, "contaminated")).alias("b"),F.col(f"d.{id_col}").eqNullSafe(F.col("b.bad_doc")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("b.bad_digest")), "left_anti")


#: DuckDB SQL without fingerprints: every aligned window around a shared shingle, verified exactly. It tries fewer windows
#: than ``matches``: those within a fifth of the item's shingles of an aligned one, so it cannot judge passages with moved parts.
SQL = r"""
    WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark WHERE text IS NOT NULL),
    dsh AS (SELECT doc_id, len(w) AS n, unnest([array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]) AS h, unnest(range(len(w) - 4)) AS p FROM w WHERE len(w) >= 5),
    ish AS (SELECT item_id, len(w) AS s, unnest([array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]) AS h, unnest(range(len(w) - 4)) AS q FROM i WHERE len(w) >= 5),
    starts AS (SELECT DISTINCT doc_id, n, item_id, s, p - q AS start FROM dsh JOIN ish USING (h)),
    windows AS (SELECT DISTINCT doc_id, item_id, s, greatest(start + g, 0) AS a, least(start + g + s, n) AS b
                FROM (SELECT *, unnest(range(-floor((s - 4) * 0.2)::BIGINT, floor((s - 4) * 0.2)::BIGINT + 1)) AS g FROM starts)),
    good AS (SELECT * FROM windows WHERE b - a >= 5),
    inside AS (SELECT doc_id, item_id, s, a, b, h, count(*) AS c FROM good JOIN dsh USING (doc_id) WHERE p >= a AND p + 5 <= b GROUP BY ALL),
    bag AS (SELECT item_id, h, count(*) AS c FROM ish GROUP BY ALL),
    common AS (SELECT x.doc_id, x.item_id, x.s, x.a, x.b, sum(least(x.c, y.c)) AS m FROM inside x JOIN bag y USING (item_id, h) GROUP BY ALL),
    scored AS (SELECT doc_id, item_id, a, b, m / ((b - a - 4) + (s - 4) - m) AS similarity FROM common),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a, b DESC) AS r FROM scored WHERE similarity >= 0.8)
    SELECT doc_id, item_id, round(similarity, 6) AS similarity, a::BIGINT AS start_word, (b - a)::BIGINT AS n_words FROM best WHERE r = 1"""
