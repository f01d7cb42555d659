"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each phrase is the longest one seen
before plus one code point. The phrases are hashed, and ``HASHES`` smallest
hashes over the set, one per hash function, are the fingerprint: 8 hex digits
each. The share of equal places of two fingerprints estimates the Jaccard
similarity of the phrase sets, which is high where one text helps to compress
the other.

Defined cases: a null text counts as empty; an empty text has no phrase and
all its places are ffffffff, so two empty texts are alike (1) and an empty
one is unlike any other; texts of any length are parsed whole; null ids come
last in the order of neighbours; ties go by the text's hash; repeated rows are
neighbours of each other; a table of one row is its own neighbour; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import text_of

HASHES = 64
#: Rows of a part of the table that one task walks through in order, about.
PART_ROWS = 5_000
#: Boundaries that the driver holds at most; beyond them the parts grow. A part is walked row by row, never held whole.
MOST_PARTS = 50_000
_KEY = "lempel-ziv-order"
_rng = np.random.default_rng(7)
_A = (_rng.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def phrases(text: str, seen: set[str]) -> None:
    """Parse ``text`` and add its phrases to ``seen``; a last phrase that was seen before adds nothing."""
    add, now = seen.add, ""
    for c in text:
        now += c
        if now not in seen:
            add(now)
            now = ""


def _parse(text: str, cut: int, tail: str) -> tuple[set[str], set[str]]:
    """Phrases of ``text`` and of ``text[:cut] + tail``: they share the parse up to the cut."""
    seen: set[str] = set()
    add, now = seen.add, ""
    for c in text[:cut]:
        now += c
        if now not in seen:
            add(now)
            now = ""
    other, open_ = set(seen), now
    for s, n, rest in ((seen, now, text[cut:]), (other, open_, tail)):
        put = s.add
        for c in rest:
            n += c
            if n not in s:
                put(n)
                n = ""
    return seen, other


def signature(found: set[str]) -> np.ndarray:
    if not found:
        return np.full(HASHES, 0xFFFFFFFF, np.uint32)
    h = pd.util.hash_array(np.array(list(found), dtype=object), hash_key=_KEY, categorize=False)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(h), 50_000):
        part = h[a:a + 50_000]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def _in_order(docs: DataFrame) -> tuple[DataFrame, list, int]:
    """Rows with the part they belong to (parts go down by id), the head of each part, and the number of parts. The
    driver holds a boundary and a head's id for each part only."""
    rows = docs.withColumn("tie", F.xxhash64("text"))
    count = rows.count()
    parts = min(MOST_PARTS, max(1, count // PART_ROWS))
    cuts = sorted(set(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    marks = np.array(sorted(-c for c in cuts))

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, k.to_numpy(), side="right").astype("int32"))

    last = F.col("id").isNull()
    rows = rows.withColumn("part", F.when(last, F.lit(len(marks) + 1)).otherwise(place(-F.coalesce(F.col("id").cast("double"), F.lit(0.0)))) if len(marks) else last.cast("int"))
    heads = rows.groupBy("part").agg(F.max(F.struct("id", "tie")).alias("h")).collect()
    return rows, heads, parts


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of ``docs``.

    The edited text is the text with its last third (rounded down) replaced by the first as many code points of
    the next document in descending id; after the last comes the first.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows, heads, parts = _in_order(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    order = sorted((h.part for h in heads))
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the part that needs the head of p after its own rows
    own = rows.withColumn("halo", F.lit(False))
    if heads:  # each part is followed by the head of the next one, the last part by the head of the first
        spark = docs.sparkSession
        want = spark.createDataFrame([(h.part, h.h.id, h.h.tie, before[h.part]) for h in heads], f"part int, id {id_type}, tie bigint, goes int")
        halo = rows.alias("r").join(F.broadcast(want).alias("w"), (F.col("r.part") == F.col("w.part")) & F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.tie") == F.col("w.tie")))
        halo = halo.select("r.id", "r.text", "r.tie", F.col("w.goes").alias("part"), F.lit(True).alias("halo"))
        own = own.select("id", "text", "tie", "part", "halo").unionByName(halo)
    placed = own.repartition(max(1, parts), "part").sortWithinPartitions("part", "halo", F.desc_nulls_last("id"), F.desc("tie"))
    placed = placed.withColumn("id", F.col("id").cast("string"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (id, text, part) that waits for the next row

        def flush(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        def made(item: tuple, nxt: str) -> tuple:
            text = item[1]
            third = len(text) // 3
            cut, tail = len(text) - third, nxt[:third]
            seen, other = _parse(text, cut, tail)
            sha = sha256((text[:cut] + tail).encode("utf-8", "surrogatepass")).hexdigest()
            return item[0], len(text), sha, signature(seen), signature(other)

        pending = None  # a made row whose neighbour's fingerprint is still to come
        for df in batches:
            out: list = []
            for id_, text, part, halo in zip(df["id"], df["text"], df["part"], df["halo"], strict=True):
                if last is not None and last[2] == part:
                    row = made(last, text)
                    if pending is not None:
                        out.append(_row(pending, row[3]))
                    pending = row
                    if halo:
                        seen: set[str] = set()
                        phrases(text, seen)
                        out.append(_row(pending, signature(seen)))
                        pending = None
                last = None if halo else (id_, text, part)
            if out:
                yield flush(out)

    schema = "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select("id", "text", "part", "halo").mapInPandas(walk, schema).withColumn("id", F.col("id").cast(id_type))


def _row(made: tuple, neighbour: np.ndarray) -> tuple:
    id_, n, sha, own, edited = made
    return id_, n, sha, _hex(own), _hex(edited), likeness(own, edited), likeness(own, neighbour)
