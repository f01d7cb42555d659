"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans follow the fixed patterns below and always stay. Further candidates
(obfuscated addresses, numbers in other spellings) are judged by labelers: a
pattern, a checksum or range, a gazetteer of words nearby, the characters
around, and words that speak against it. Each labeler votes yes, no or
nothing. Votes of all candidates of the corpus, base ones included, are
counted by pattern; expectation-maximisation over these counts estimates each
labeler's reliability per kind and the chance of each vote pattern. A logistic
classifier of votes and shape is trained on those chances over all
candidates. Further candidates it finds likely (at least ``LIMIT``) are added
where they overlap no span yet, leftmost first.

Defined cases: a null text counts as empty; a text without spans has empty
lists; spans are in code points, end exclusive; texts of any length are read
whole; repeated rows each get their spans; null ids are kept; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
LIMIT = 0.5

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_HEX = re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]")

# Further candidates.
_FURTHER = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[({]\s?dot\s?[\])}]|\.)\s?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])")),
    ("card", re.compile(r"(?<![0-9.\x20-])[0-9]{4}(?:[.\xa0][0-9]{4}){3}(?![0-9.-])")),
    ("phone", re.compile(r"(?<![0-9+().-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.-])")),
)

# Gazetteer of words near each kind, and words that speak against all of them.
NEAR = {
    "email": frozenset("mail email e-mail contact write courriel correo kontakt address adresse".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address adresse client login connected".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte tarjeta kreditkarte payment".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell téléphone telefon teléfono appel ruf".split()),
}
AGAINST = frozenset("version v isbn issn order serial section rev build token sha id nr no doi invoice ticket".split())
_WORDS = re.compile(r"[^\W\d_][\w-]*")

#: Votes of a labeler.
YES, NOTHING, NO = 1, 0, -1
LABELERS = ("pattern", "check", "gazetteer", "around", "against")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 4 and (not x or int(x) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern from left to right, found from their @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order; kinds may overlap each other, spans of a kind do not."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def further(text: str) -> list[tuple[int, int, int]]:
    """Candidates beyond the base patterns, in order. A pattern is only run on texts that hold what it cannot do without."""
    has = (_AT.search(text), _HEX.search(text) if ":" in text else None, digit := _DIGIT.search(text), digit)
    return sorted((m.start(), KINDS.index(kind), m.end()) for (kind, pattern), may in zip(_FURTHER, has, strict=True) if may for m in pattern.finditer(text))


def votes(text: str, start: int, kind: int, end: int, base: bool) -> str:
    """The labelers' votes and the span's shape as a short key: these are all the classifier sees."""
    span, name = text[start:end], KINDS[kind]
    digits = _DIGITS.sub("", span)
    if name == "email":
        check = YES if re.search(r"[.\s\])}](com|org|net|edu|gov|info|io|[a-z]{2})$", span, re.I) else NO
    elif name == "ip":
        check = YES if ":" in span or all(map(_octet, span.split("."))) else NO
    elif name == "card":
        check = YES if luhn(digits) else NO
    else:
        check = YES if 10 <= len(digits) <= 15 else NO if len(digits) < 9 else NOTHING
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 40):start])[-4:]]
    near = YES if any(w in NEAR[name] for w in before) else NOTHING
    left, right = text[start - 1:start], text[end:end + 1]
    around = NO if left.isalnum() or right.isalnum() else YES if (not left or left.isspace()) and (not right or right.isspace() or right in ".,;!?") else NOTHING
    against = NO if (before and before[-1] in AGAINST) or left in ("=", "#", '"', "/") or len(set(digits)) == 1 and len(digits) > 3 else NOTHING
    seen = (YES if base else NOTHING, check, near, around, against)
    return f"{kind}:{''.join('-0+'[v + 1] for v in seen)}:{int(' ' in span)}{min(3, len(span) // 8)}"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter = Counter()
    for df in batches:
        for text in df["text"]:
            own = base_spans(text)
            found.update(votes(text, a, k, b, True) for a, k, b in own)
            taken = _merged(own)
            found.update(votes(text, a, k, b, False) for a, k, b in further(text) if not _overlaps(taken, a, b))
    if found:
        yield pd.DataFrame({"key": list(found.keys()), "n": list(found.values())})


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _overlaps(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether one of the stretches (in order, apart from each other) meets a:b."""
    i = bisect_left(taken[0], b) - 1
    return i >= 0 and taken[1][i] > a


def estimate(counts: dict[str, int], steps: int = 50) -> tuple[dict[str, float], dict[tuple[int, str], tuple[float, float]]]:
    """EM over vote patterns: the chance of each key, and (kind, labeler) -> (share right on true spans, on false ones).

    Each labeler votes by itself given the truth; vote rates start from the belief that yes votes are mostly right
    and are smoothed by one pseudo-vote each.
    """
    chance, rates = {}, {}
    for kind in range(len(KINDS)):
        keys = [k for k in sorted(counts) if k.startswith(f"{kind}:")]
        if not keys:
            continue
        n = np.array([counts[k] for k in keys], float)
        v = np.array([["-0+".index(c) for c in k.split(":")[1]] for k in keys])
        one = (v[:, :, None] == np.arange(3)[None, None, :]).astype(float)
        p = np.clip(0.5 + 0.2 * (v - 1).sum(1), 0.05, 0.95)
        for _ in range(steps):
            true = ((n * p)[:, None, None] * one).sum(0) + 1
            false = ((n * (1 - p))[:, None, None] * one).sum(0) + 1
            # a yes vote is taken to speak for a span at least as much as against it
            true, false = true / true.sum(1, keepdims=True), false / false.sum(1, keepdims=True)
            prior = np.clip((n * p).sum() / n.sum(), 0.05, 0.95)
            log = np.log(prior / (1 - prior)) + (one * np.log(true / false)[None]).sum((1, 2))
            p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        chance |= dict(zip(keys, p.tolist(), strict=True))
        rates |= {(kind, name): (float(true[i, 2]), float(false[i, 0])) for i, name in enumerate(LABELERS)}
    return chance, rates


def _features(key: str) -> np.ndarray:
    kind, seen, shape = key.split(":")
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 5)
    x[0] = x[1 + int(kind)] = 1
    for i, c in enumerate(seen):
        if c != "0":
            x[1 + len(KINDS) + 2 * i + (c == "+")] = 1
    x[-5] = int(shape[0])
    x[-4 + int(shape[1])] = 1
    return x


def classifier(counts: dict[str, int], chance: dict[str, float], steps: int = 60, ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression by Newton's steps on all candidates, with the estimated chances as soft labels; key -> chance."""
    if not counts:
        return {}
    keys = sorted(counts)
    x, y = np.array([_features(k) for k in keys]), np.array([chance[k] for k in keys])
    n, w = np.array([counts[k] for k in keys], float), np.zeros(len(_features(keys[0])))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Vote pattern -> chance, learned from the candidates of all rows. The driver gets counts of patterns (a few thousand at most)."""
    rows = docs.select(text_of(text_col).alias("text")).filter("text rlike '[0-9@]' OR lower(text) rlike '[(\\\\[{] ?at ?[)\\\\]}]'")
    counts = {r.key: r.n for r in rows.mapInPandas(_counted, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    return classifier(counts, estimate(counts)[0])


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the counts and the digest are of base spans."""
    none = sha256(b"").hexdigest()

    @F.pandas_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_added: long>")
    def spans(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            base = base_spans(t)
            every, taken, reached = list(base), _merged(base), 0
            for a, k, b in further(t):  # in order, so that those added end where the last one does
                if a >= reached and not _overlaps(taken, a, b) and model.get(votes(t, a, k, b, False), 0.0) >= LIMIT:
                    every.append((a, k, b))
                    reached = b
            n = Counter(k for _, k, _ in base)
            said = _text(base)
            out.append((n[0], n[1], n[2], n[3], sha256(said.encode()).hexdigest() if base else none, _text(sorted(every)), len(every) - len(base)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col).alias("id"), spans(text_of(text_col)).alias("s")).select("id", "s.*")
