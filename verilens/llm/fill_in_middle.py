"""Fill-in-middle transformation by secondary sort.

A text is cut into units; a prefix and a middle of them end at places that a
hash of the id draws, and the parts are put out in one of two orders behind
sentinels, or plainly. No task puts a whole output together: ``pieces`` emits
chunks of units keyed by document and place in the output. They are dealt by
document and sorted by (document, place) within partitions, which is the
DataFrame form of repartitionAndSortWithinPartitions: the sort is the JVM's and
spills, and a task streams its pieces in order. ``digested`` feeds them to an
incremental digest. Restoration reads the same stream and knows nothing but
the output and its form: sentinels tell the parts, the parts' places are their
order in the text, and a second sort within the same partitions (no further
shuffle) streams the pieces, now in that order, into a digest of the restored
text. ``outputs`` gives the outputs themselves.

Defined cases: a null text counts as empty; an empty text is plain with no
units; a very long text or unit is one row on the way in and pieces from there
(a unit is never cut, so a piece is as long as its longest unit at least); a
null id is hashed as no digits; ids of other types by their decimal or plain
text. Rows that agree in id and text are interchangeable: each carries a number
among its equals in its input partition, so each gives its own row, equal rows
are spread over tasks, and a task that runs again emits the same keys whatever
order it reads in. Rows that share an id but not the text are parted by the
text's hash. An empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import text_of

#: A unit is a word with the white space before it, or white space that no word follows.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = re.compile("<[PSM]>")
SEED = 42
#: Of 100 documents so many are transformed, and of those so many suffix first.
RATE, SPM_RATE = 50, 80
#: Units in a piece.
CHUNK = 512

KEY = ["id", "digest", "part", "copy"]
_ID = "id string, digest long, part int, copy long"
_PIECES = f"{_ID}, place long, n long, form string, prefix_chars long, middle_chars long, piece string"
_RESTORE = f"{_ID}, section int, place long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, piece string"
_DIGESTS = f"{_ID}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_TEXTS = f"{_ID}, n long, form string, prefix_chars long, middle_chars long, output string"
#: Sections of the text in the order in which a form puts them out.
ORDER = {"plain": [0], "psm": [0, 2, 1], "spm": [2, 0, 1]}
_MARK = {0: PREFIX, 1: MIDDLE, 2: SUFFIX}


def _draws(doc_id: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def arrangement(doc_id: str, text: str, n: int, seed: int = SEED) -> tuple[str, int, int]:
    """(form, units in the prefix, units up to the middle's end)."""
    h1, h2, h3, h4 = _draws(doc_id, seed)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or SENTINEL.search(text) or h3 % 100 >= RATE:
        return "plain", n, n
    return ("spm" if h4 % 100 < SPM_RATE else "psm"), a, b


def _document(doc_id: str, text: str, seed: int, chunk: int) -> Iterator[tuple[int, str, int | None, int | None, str]]:
    """(units, form, characters in prefix, in middle, piece) of each piece in the order of the output."""
    units = UNIT.findall(text)
    form, a, b = arrangement(doc_id, text, len(units), seed)
    cuts = {0: (0, a), 1: (a, b), 2: (b, len(units))}
    chars = (None, None) if form == "plain" else (sum(map(len, units[:a])), sum(map(len, units[a:b])))
    if not units:
        yield 0, form, *chars, ""
    for section in ORDER[form]:
        if form != "plain":
            yield len(units), form, *chars, _MARK[section]
        lo, hi = cuts[section]
        for at in range(lo, hi, chunk):
            yield len(units), form, *chars, "".join(units[at:min(at + chunk, hi)])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The pieces of every output: key columns, ``place`` in the output, the row's figures, ``piece``."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text")).select("id", "text", F.xxhash64("text").alias("digest"), F.spark_partition_id().alias("part"))

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: Counter = Counter()
        for doc, text, digest, part in _rows(batches):
            copy = seen[doc, digest]
            seen[doc, digest] += 1
            for place, piece in enumerate(_document("" if doc is None else doc, text, seed, chunk)):
                yield doc, digest, part, copy, place, *piece

    return rows.mapInArrow(lambda batches: _record(emitted(batches), _PIECES), _PIECES)


def dealt(made: DataFrame) -> DataFrame:
    """Pieces dealt by document and, within partitions, in the order of each output."""
    return made.repartition(*KEY).sortWithinPartitions(*KEY, "place")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(spec: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in spec.split(", ")])


def _record(rows: Iterator[tuple], spec: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    schema = _schema(spec)
    out, held = [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        held += 100 + len(row[-1] or "")
        if held > size:
            yield packed()
            out, held = [], 0
    if out:
        yield packed()


class _Sections:
    """Parts of an output, told by its sentinels as the output streams by.

    No sentinel overlaps itself or another, and a transformed text holds none,
    so whatever looks like one is one; the last two characters of what has come
    wait for the next piece, as a sentinel may begin there.
    """

    def __init__(self, form: str):
        self.order = iter(ORDER[form])
        self.plain = form == "plain"
        self.section = 0 if self.plain else -1
        self.rest = ""

    def feed(self, piece: str, last: bool = False) -> list[tuple[int, str]]:
        if self.plain:
            return [(0, piece)] if piece else []
        text, out, at = self.rest + piece, [], 0
        for m in SENTINEL.finditer(text):
            if m.start() > at:
                out.append((self.section, text[at:m.start()]))
            self.section, at = next(self.order), m.end()
        end = len(text) if last else max(at, len(text) - 2)
        if end > at:
            out.append((self.section, text[at:end]))
        self.rest = text[end:]
        return out


def digested(made: DataFrame) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each document from its pieces.

    The first pass streams an output into its digest and gives the pieces their
    places in the text; the second streams these into the digest of the
    restored text. Both are sorts within one and the same dealing.
    """
    def parted(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = head = digest = sections = None
        count = 0

        def told(found):
            nonlocal count
            for section, text in found:
                count += 1
                yield *key, section, count, None, None, None, None, None, text

        for row in rows:
            if row[:4] != key or digest is None:
                if digest is not None:
                    yield from told(sections.feed("", True))
                    yield *key, -1, 0, *head, digest.hexdigest(), None
                key, head, digest, sections, count = row[:4], row[5:9], hashlib.sha256(), _Sections(row[6]), 0
            digest.update(row[9].encode("utf-8"))
            yield from told(sections.feed(row[9]))
        if digest is not None:
            yield from told(sections.feed("", True))
            yield *key, -1, 0, *head, digest.hexdigest(), None

    def restored(rows: Iterator[tuple]) -> Iterator[tuple]:
        head = digest = None
        for row in rows:
            if row[4] == -1:  # a document's first row
                if head is not None:
                    yield *head, digest.hexdigest()
                head, digest = (*row[:4], *row[6:11]), hashlib.sha256()
            else:
                digest.update(row[11].encode("utf-8"))
        if head is not None:
            yield *head, digest.hexdigest()

    first = dealt(made).mapInArrow(lambda b: _record(parted(_rows(b)), _RESTORE), _RESTORE)
    return first.sortWithinPartitions(*KEY, "section", "place").mapInArrow(lambda b: _record(restored(_rows(b)), _DIGESTS), _DIGESTS)


def outputs(made: DataFrame) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): the transformed texts, one row each."""
    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, head, own = None, None, []
        for row in rows:
            if row[:4] != key or head is None:
                if head is not None:
                    yield *key, *head, "".join(own)
                key, head, own = row[:4], row[5:9], []
            own.append(row[9])
        if head is not None:
            yield *key, *head, "".join(own)

    return dealt(made).mapInArrow(lambda b: _record(joined(_rows(b)), _TEXTS), _TEXTS)


def restore(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    sections = _Sections(form)
    found = [*sections.feed(output), *sections.feed("", True)]
    return "".join(text for _, text in sorted(found, key=lambda f: f[0]))


#: DuckDB SQL: cuts, forms and digests from the definition.
SQL = r"""
    WITH hex AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
    num AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hex),
    cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM num),
    parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM parts"""
