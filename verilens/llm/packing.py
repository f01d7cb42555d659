"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs ``LINEAR`` n + ``QUADRATIC`` n^2 (attention within the
piece). Documents are dealt by a hash into groups of about ``GROUP_CHARS``
characters. Whole sequences are cut off long documents first. In each group
the rest go in descending order, each to the sequence of lowest cost among
those with room for it; the group has as many sequences as its tokens need. A
document that fits nowhere is cut: a piece fills the sequence with most room,
and the rest goes on. A group leaves less than one sequence of padding.

Defined cases: a null text counts as empty and gives only the end id; a
document of any length is cut into pieces; rows that repeat are packed each
by itself; null ids are kept; ties go to the sequence with the lowest number;
an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import text_of

CAPACITY = 2048
END = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Characters of text in a group: a few million tokens, tens of MB in a task.
GROUP_CHARS = 6_000_000
#: Ways in which equal rows are dealt.
COPIES = 4096
#: Chunks whose ids a Python worker remembers (some 100 MB).
REMEMBERED = 400_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The vocabulary's own split of a text without white space.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Text in which that split is the same for all Unicode versions, and which normalisation leaves as it is once it is in lower case.
_LATIN = "^[!-~\u00a1-\u024f]+$"
#: Bytes of text that are encoded side by side.
SLICE = 2_000_000
#: Words that are encoded as one text.
TOGETHER = 200


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts. Chunks between ASCII white space are encoded by themselves and remembered: the vocabulary's
    splitting never joins across white space, and ASCII letters are lower-cased by it anyway. A new Latin chunk is
    split as the vocabulary does, and its unknown words are encoded many in one text: the last token of each word is
    one that ends words. Texts that may hold special tokens are encoded as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # the same model for words that need neither normalisation nor a split
        plain = json.loads(self.tokenizer.to_str())
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(
            x for x in plain["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")]}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space, many of them in one text."""
        out: list[bytes] = []
        for a in range(0, len(words), TOGETHER):
            part = words[a:a + TOGETHER]
            raw = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u4").tobytes()
            ends = ((np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1) * 4).tolist()
            if len(ends) == len(part) and ends[-1] == len(raw):
                out += [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._raw(part)
        return out

    def _learn(self, chunks: pa.Array) -> None:
        """Remember the ids of new chunks (in ASCII lower case)."""
        known, split, words = self.known, [], {}
        latin = pc.and_(pc.match_substring_regex(chunks, _LATIN), pc.equal(pc.utf8_lower(chunks), chunks))
        alpha = pc.and_(latin, pc.utf8_is_alpha(chunks))
        mixed = pc.and_(latin, pc.invert(pc.utf8_is_alpha(chunks)))
        for c in _strings(chunks.filter(mixed)):
            own = _SPLIT.findall(c)
            split.append((c, own))
            for part in own:
                if part not in known:
                    words[part] = None
        words.update(dict.fromkeys(_strings(chunks.filter(alpha))))
        new = list(words)
        known.update(zip(new, self._words(new), strict=True))
        for c, own in split:
            known[c] = b"".join([known[part] for part in own])
        whole = _strings(chunks.filter(pc.invert(latin)))
        known.update(zip(whole, self._raw(whole), strict=True))

    def _of_chunks(self, chunks: pa.Array) -> list[bytes]:
        """Ids of each of these different chunks."""
        names = _strings(chunks)
        if len(self.known) + len(names) > REMEMBERED:  # what was learnt first goes
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        got = list(map(self.known.get, names))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            self._learn(chunks.take(pa.array(missing)))
            for i in missing:
                got[i] = self.known[names[i]]
        return got

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text begins and the last ends)."""
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, "", texts) if pc.any(special).as_py() else texts
        parts = pc.ascii_split_whitespace(pc.ascii_lower(plain)).cast(pa.list_(pa.string()))
        coded = parts.flatten().dictionary_encode()
        own = self._of_chunks(coded.dictionary)
        first = np.cumsum([0, *(len(x) // 4 for x in own)], dtype=np.int32)
        table = pa.ListArray.from_arrays(pa.array(first), pa.Array.from_buffers(pa.uint32(), int(first[-1]), [None, pa.py_buffer(b"".join(own))]))
        taken = table.take(coded.indices)
        ids = taken.flatten().to_numpy()
        before = np.r_[0, np.cumsum(taken.value_lengths().to_numpy(), dtype=np.int64)]
        ends = before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        if plain is not texts:  # texts with what may be special tokens are encoded as they are
            at = np.flatnonzero(special.to_numpy(zero_copy_only=False))
            whole = dict(zip(at.tolist(), (np.frombuffer(x, "<u4") for x in self._raw([texts[i].as_py() for i in at.tolist()])), strict=True))
            each = [whole.get(i, ids[ends[i]:ends[i + 1]]) for i in range(len(texts))]
            ids, ends = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        return ids, ends

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some 2 MB of text, a longer text by itself."""
    size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of pieces; ``sizes`` are at most ``capacity`` and in descending order."""
    n = math.ceil(sum(sizes) / capacity)
    room, costs, out = np.full(n, capacity), np.zeros(n), []
    for doc, size in enumerate(sizes):
        start = 0
        while size:
            fits = np.flatnonzero(room >= size)
            to = int(fits[np.argmin(costs[fits])]) if len(fits) else int(np.argmax(room))
            length = min(size, int(room[to]))
            out.append((doc, start, length, to))
            room[to] -= length
            costs[to] += cost(length)
            start, size = start + length, size - length
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 1
    groups = max(1, math.ceil(total / GROUP_CHARS))
    # rows that repeat are dealt by their place as well, so that no group grows with them
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id() % COPIES), F.lit(groups)))
    small = "<u2" if _encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"  # of an id on the way to the groups

    def coded(encode: Encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = encode.flat(part.column(2))
        n = part.num_rows
        made = np.insert(ids.astype(small), ends[1:], END)  # every text's ids and its end
        at = ((ends + np.arange(n + 1)) * made.itemsize).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(made)]).cast(pa.binary())
        return pa.record_batch([part.column(0), part.column(1), pa.array(np.diff(ends) + 1, pa.int32()), column], ["id", "grp", "tokens", "ids"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for part in _slices(batch):
                pa.default_memory_pool().release_unused()  # a worker keeps what earlier slices, and earlier steps, took
                yield coded(encode, part)

    def packed(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["tokens", "id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
        pieces, rest = [], []
        number = 0
        for i, n in enumerate(df["tokens"]):
            for start in range(0, n - n % capacity, capacity):
                pieces.append((i, start, capacity, number))
                number += 1
            if n % capacity:
                rest.append((n % capacity, -i))
        rest.sort(reverse=True)
        pieces += [(-rest[d][1], int(df["tokens"][-rest[d][1]]) - rest[d][0] + start, length, number + to) for d, start, length, to in assign([n for n, _ in rest], capacity)]
        used: dict[int, int] = {}
        out, ids, base = [], df["ids"], int(df["grp"][0]) << 32
        for i, start, length, to in pieces:
            crc = zlib.crc32(np.frombuffer(ids[i], small)[start:start + length].astype("<u4").tobytes())
            out.append((df["id"][i], start, length, crc, int(df["tokens"][i]), base + to, used.get(to, 0)))
            used[to] = used.get(to, 0) + length
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame(out, columns=names).astype({n: "int64" for n in names[1:]})

    made = rows.withColumn("id", F.col("id").cast("string")).select("id", "grp", "text").mapInArrow(encoded, "id string, grp bigint, tokens int, ids binary")
    pieces = made.groupBy("grp").applyInPandas(packed, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("id", F.col("id").cast(id_type))
