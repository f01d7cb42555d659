"""Near-duplicate documents by Order MinHash with verification by banded alignment.

A text is the sequence of its five-word runs (k-mers), each labelled with its
occurrence number, so that no labelled k-mer stands twice in a text. Each of
``sketches`` hash functions keeps the ``ell`` smallest labelled k-mers and
hashes them in text order: texts agree on such a key if they share those
k-mers in the same order. Texts of up to ``SHORT`` k-mers also have their smallest
k-mers as keys, so many that two such texts over the threshold share one for
certain. Texts with a common key are candidates; a pair is aligned if its
lengths allow the threshold. In each
bucket of a key the text that shares most keys with others is compared with
the others, and where a bucket still holds several classes, further texts are
(more in each round) until its classes are settled or every text of it has been compared. From the
second round on, k-mers that no other text of these buckets has are counted: a
pair whose remaining k-mers cannot reach the threshold is no link. A
candidate pair is a link if the best alignment of the two sequences within a
band aligns at least ``threshold`` of their union:
m / (n_a + n_b - m) >= threshold. Classes are the components of the links.

Defined cases: a null text counts as empty; texts without words are alike only
if equal; texts of fewer than five words have one k-mer, all their words; a
null id sorts after others; rows may repeat; an empty table gives an empty
result. Texts with the same words in the same order are copies whatever their
punctuation and case.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import free_name, stored, text_of
from verilens.llm.components import components

K, SKETCHES, ELL, THRESHOLD = 5, 32, 5, 0.8
#: Texts of up to so many k-mers have k-mers as keys. In a longer pair at exactly 0.8 (21 of 26 k-mers or more) a key
#: agrees with a chance of at least C(21, 5) / C(26, 5) = 0.309, so that it shares none of 32 with a chance of 0.000007 at most.
SHORT = 25
#: Elements of the table of hashes made at once (4 MB).
AT_ONCE = 500_000
#: Words whose hashes a Python worker remembers: most words of a web corpus come once, and a worker keeps the memory they took (100 MB for 330,000).
REMEMBERED = 40_000
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_UPPER = np.uint64(0xFFFFFFFF00000000)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def kmers(words: list[str]) -> np.ndarray:
    """Hashes of the labelled k-mers of a text, in text order, all different."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(K, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = (h + w[i:n - k + 1 + i]) * _ODD
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    if len(start) < len(s):
        number = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
        h[order] = _mix(s + number.astype(np.uint64) * _ODD)
    return h


def keys(h: np.ndarray) -> np.ndarray:
    """A key per hash function: the smallest labelled k-mers in text order."""
    out = np.empty(SKETCHES, np.uint64)
    seeds = _mix((np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1)) * _ODD)
    step = max(1, AT_ONCE // max(1, len(h)))
    for a in range(0, SKETCHES, step):
        s = seeds[a:a + step]
        if len(h) > ELL:  # the upper half of a value is the hash, the lower half the place
            table = h[None, :] ^ s[:, None]
            table *= _MIX
            table &= _UPPER
            table |= np.arange(len(h), dtype=np.uint64)
            table.partition(ELL - 1, axis=1)
            at = np.sort(table[:, :ELL] & ~_UPPER, axis=1).astype(np.int64)
        else:
            at = np.broadcast_to(np.arange(len(h)), (len(s), len(h)))
        picked = h[at]
        key = s.copy()
        for i in range(picked.shape[1]):
            key = _mix(key + picked[:, i] * _ODD)
        out[a:a + step] = key
    return out


def short_keys(h: np.ndarray, threshold: float) -> np.ndarray:
    """Of a text of up to ``SHORT`` k-mers the smallest ones: two texts that share ``threshold`` of their union share one of these."""
    n = len(h)
    if not n or n > SHORT:
        return np.empty(0, np.uint64)
    return _mix(np.sort(h)[:n - int(np.ceil(threshold * n - 1e-9)) + 1] + _ODD)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within ``band`` places of each other.

    Labelled k-mers stand once in a text, so the matches are a partial
    permutation and their longest rising chain is the alignment.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    close = np.abs(i - j) <= band
    i, j = i[close], j[close]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at:at + 1] = [x]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """m / (n_a + n_b - m). No alignment at or over the threshold leaves the band: a match d places apart leaves d unmatched."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    m = aligned(a, b, int(total * (1 - threshold) / (1 + threshold)) + 1)
    return m / (total - m)


def _sketched(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            nodes, sizes, found = [], [], []
            for text in df["text"]:
                words = _WORD.findall(text.lower())
                raw = " ".join(words) if words else "\0" + text
                nodes.append(blake2b(raw.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                h = kmers(words)
                sizes.append(len(h))
                found.append(np.concatenate([keys(h), short_keys(h, threshold)]).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pd.DataFrame({"id": df["id"], "place": df["place"], "node": nodes, "n": sizes, "keys": found})

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h = None, None
        for df in batches:
            good = []
            for p, text_p, text_v in zip(df["a"], df["text_a"], df["text_b"], strict=True):
                if p != last:
                    last, h = p, kmers(_WORD.findall(text_p.lower()))
                good.append(likeness(h, kmers(_WORD.findall(text_v.lower())), threshold) >= threshold)
            yield df.loc[good, ["a", "b"]]

    return run


def _kmer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        found = [kmers(_WORD.findall(text.lower())).view(np.int64) for text in df["text"]]
        if found:
            yield pd.DataFrame({"kmer": np.concatenate(found), "owner": np.repeat(df["owner"].to_numpy(), [len(h) for h in found])})


def _shared_kmers(texts: DataFrame) -> DataFrame:
    """(node, lone): how many labelled k-mers of each text no other text has; nodes with none are left out."""
    rows = texts.select(F.xxhash64("node").alias("owner"), "text").mapInPandas(_kmer_rows, "kmer bigint, owner bigint")
    lone = rows.groupBy("kmer").agg(F.count("*").alias("texts"), F.min("owner").alias("owner")).filter("texts = 1").groupBy("owner").agg(F.count("*").alias("lone"))
    return texts.select("node", F.xxhash64("node").alias("owner")).join(lone, "owner").select("node", "lone")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, class_id, first): a row per row of ``docs``.

    ``place`` is xxhash64 of the text (null counts as empty), ``class_id`` the smallest id of the
    class, ``first`` marks the row that stands for the class (smallest id, then place; rows that agree in both share it).
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("place", F.xxhash64("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    made = rows.select(F.col("id").cast("string").alias("id"), "place", "text").mapInPandas(_sketched(threshold), "id string, place bigint, node binary, n int, keys array<bigint>")
    sketched = stored(made.withColumn("id", F.col("id").cast(id_type)), "sketches")
    rep = F.struct(F.col("id").isNull().alias("last"), "id", "place")
    links = stored(_links(rows, sketched, threshold), "links")
    comps = components(links)
    sized = sketched.join(comps, "node", "left").select("id", "place", F.coalesce("comp", "node").alias("comp"))
    heads = sized.groupBy("comp").agg(F.min(rep).alias("head"))
    return sized.join(heads, "comp").select(
        "id", "place", F.col("head.id").alias("class_id"), rep.eqNullSafe(F.col("head")).alias("first"))


def _agreeing(a: str, b: str, at: str) -> Column:
    """On how many keys of the hash functions two texts agree before place ``at``."""
    same = [(F.col(a)[i] == F.col(b)[i]).cast("int") for i in range(SKETCHES)]
    return sum((F.when(F.col(at) > i, x).otherwise(0) for i, x in enumerate(same)), F.lit(0))


def _links(rows: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """(a, b): verified pairs of different texts, enough of them to join each class."""
    where = F.struct("id", "place")
    nodes = sketched.filter("n > 0").groupBy("node").agg(F.min_by("keys", "place").alias("keys"), F.max("n").alias("n"), F.min(where).alias("at"))
    nodes = stored(nodes, "nodes")
    # the lists of keys meet only the texts that can be in a pair: those with a key that other texts have too
    held = nodes.select("node", F.posexplode("keys").alias("at_key", "key"))
    shared = held.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(held.join(shared, "key").select("node", "key", "at_key", "size"), "met")
    central = met.groupBy("node").agg(F.sum("size").alias("central"))
    marks = stored(central.select("node").join(nodes.select("node", F.col("keys").alias("marks")), "node"), "marks")
    ranked = central.join(nodes.select("node", "n"), "node").select("node", "n", F.struct("central", "node").alias("rank"), F.col("n").alias("usable"))
    members = stored(met.select("key", "at_key", "node").join(ranked, "node"), "members")
    needed = members.select("node").distinct().join(nodes.select("node", "at.*"), "node")
    at = needed.alias("q")
    texts = stored(rows.alias("r").join(at, F.col("r.id").eqNullSafe(F.col("q.id")) & (F.col("r.place") == F.col("q.place"))).select("node", "text").groupBy("node").agg(F.min("text").alias("text")), "texts")

    found = None
    tested = used = comps = lone = None
    share = 1
    while True:
        if comps is None:
            now = members.withColumn("comp", F.col("node"))
        else:  # only buckets that still hold several classes; a settled one stays settled
            now = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            split = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
            now = now.join(split, "key")
            if lone is None:
                now = stored(now, "split")
                lone = stored(_shared_kmers(texts.join(now.select("node").distinct(), "node", "left_semi")), "lone")
                # a text can only be linked if enough of its k-mers stand in other texts of these buckets
                now = now.join(lone, "node", "left").withColumn("usable", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
                now = now.filter(F.col("usable") >= threshold * F.col("n"))
            now = stored(now, "open")
            members = now.drop("comp")
        fresh = now if used is None else now.join(used, ["key", "node"], "left_anti")
        pivots = fresh.groupBy("key", F.pmod(F.xxhash64("node", F.lit(share)), F.lit(share)).alias("part")).agg(F.max(F.struct("rank", "n", "comp", "usable")).alias("p"))
        pivots = pivots.select("key", F.col("p.rank.node").alias("pivot"), F.col("p.rank").alias("pivot_rank"), F.col("p.n").alias("pivot_n"), F.col("p.comp").alias("pivot_comp"), F.col("p.usable").alias("pivot_usable"))
        pivots = stored(pivots.join(marks.select(F.col("node").alias("pivot"), F.col("marks").alias("pivot_marks")), "pivot"), "pivots")
        if comps is not None and pivots.isEmpty():
            return found
        before = _agreeing("marks", "pivot_marks", "at_key")
        # a pair is met once, at the first key it agrees on; at its common k-mers only if it agrees on no key of the hash functions
        marked = now.join(marks, "node")
        pairs = marked.join(pivots, (marked["key"] == pivots["key"]) & (F.col("comp") != F.col("pivot_comp")) & (F.col("rank") < F.col("pivot_rank")) & (F.least("n", "pivot_n") >= threshold * F.greatest("n", "pivot_n")) & (before == 0)
                          & (F.least("usable", "pivot_usable") * (1 + threshold) >= threshold * (F.col("n") + F.col("pivot_n"))))
        pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        links = stored(full.select("a", "b", "text_a", "text_b").mapInPandas(_verified(threshold), "a binary, b binary"), "verified")
        found = links if found is None else found.unionByName(links)
        tested = pairs if tested is None else tested.unionByName(pairs)
        mine = pivots.select("key", F.col("pivot").alias("node"))
        used = mine if used is None else used.unionByName(mine)
        comps = components(found)
        share *= 64


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id; rows equal in id and text are reduced to one."""
    firsts = classes(docs, threshold, id_col, text_col).filter("first").select(F.col("id").alias("first_id"), F.col("place").alias("first_place")).distinct()
    place = free_name(docs, "place")
    d = docs.withColumn(place, F.xxhash64(text_of(text_col))).alias("d")
    kept = d.join(firsts.alias("f"), F.col(f"d.{id_col}").eqNullSafe(F.col("f.first_id")) & (F.col(f"d.{place}") == F.col("f.first_place")), "left_semi")
    return kept.dropDuplicates([id_col, place]).drop(place)
