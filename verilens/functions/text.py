"""Text, script and matching expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verilens.functions import words as fixed
from verilens.functions.arrays import let

_WORD = r"\p{L}\p{N}_" + fixed.OWN_BLOCK
TOKEN_PATTERN = rf"[{_WORD}]+(?:[-'][{_WORD}]+)*|[^\s\p{{L}}\p{{N}}_]"


def tokenise(text: Column) -> Column:
    """Orthographic words with inner hyphens or apostrophes, or single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode NFC. Only rows holding a combining mark reach Python through the guard in ``nfc_where_needed``."""
    return _nfc(text)


def needs_nfc(text: Column) -> Column:
    """Only combining marks or code points with singleton mappings can change under NFC."""
    return text.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAFF}]")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column) -> Column:
    """Lower-case, punctuation to spaces, single spaces: the matching form."""
    return squeeze(F.regexp_replace(F.lower(text), rf"[^{_WORD}\s]", " "))


def normalise_key(text: Column) -> Column:
    """Lower-case without punctuation or spaces: the lexicon key."""
    return F.regexp_replace(F.lower(text), rf"[^{_WORD}]+", "")


def wer_words(text: Column) -> Column:
    """Lower-cased words with punctuation taken as a break."""
    clean = squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def is_latin(word: Column) -> Column:
    """Every letter is Latin, and there is one."""
    return word.rlike(r"\p{L}") & ~F.regexp_replace(word, r"\p{IsLatin}", "").rlike(r"\p{L}")


def latin_fraction(text: Column) -> Column:
    w = wer_words(text)
    return F.when(F.size(w) > 0, F.size(F.filter(w, is_latin)) / F.size(w)).otherwise(F.lit(0.0))


def script_of(token: Column) -> Column:
    """Script of most letters: own, sister, latin or none; ties in that order."""
    counts = F.struct(
        F.regexp_count(token, F.lit(rf"(?=\p{{L}})[{fixed.OWN_BLOCK}]")).alias("own"), F.regexp_count(token, F.lit(rf"(?=\p{{L}})[{fixed.SISTER_BLOCKS}]")).alias("sister"),
        F.regexp_count(token, F.lit(r"\p{IsLatin}")).alias("latin"))
    return let(counts, lambda n: (
        F.when((n["own"] == 0) & (n["sister"] == 0) & (n["latin"] == 0), "none")
        .when((n["own"] >= n["latin"]) & (n["own"] >= n["sister"]), "own")
        .when(n["sister"] >= n["latin"], "sister").otherwise("latin")
    ))


def split_suffix(token: Column) -> tuple[Column, Column]:
    """(stem, suffix) at the last hyphen when the tail is a known suffix; suffix NULL otherwise."""
    stem = F.regexp_extract(token, r"^(.+)-([^-]*)$", 1)
    tail = F.regexp_extract(token, r"^(.+)-([^-]*)$", 2)
    hit = (stem != "") & F.lower(tail).isin(fixed.SUFFIXES)
    return F.when(hit, stem).otherwise(token), F.when(hit, tail)


def rule_cascade(token: Column) -> Column:
    """Struct(lang, conf, reason): first matching rule; lang NULL means a model must decide. Each part of the token is computed once."""

    def hit(lang, conf, reason):
        return F.struct(F.lit(lang).cast("string").alias("lang"), F.lit(conf).alias("conf"), F.lit(reason).alias("reason"))

    def rules(p):
        s, script, low, suffix, stem = p["s"], p["script"], p["low"], p["suffix"], p["stem"]
        return (
            F.when(s == "", hit("NEUTRAL", 1.0, "empty"))
            .when(s.rlike(rf"^[^{_WORD}]+$"), hit("NEUTRAL", 1.0, "punctuation"))
            .when(s.rlike(r"^[\p{Nd}.,:/-]+$"), hit("NEUTRAL", 1.0, "numeric"))
            .when(script == "own", hit("A", 1.0, "own_script"))
            .when(script == "sister", hit("A", 0.6, "sister_script"))
            .when(script == "none", hit("NEUTRAL", 1.0, "no_letters"))
            .when(suffix.isNotNull() & stem.isin(fixed.ROMANISED), hit("A", 0.9, "romanised_with_suffix"))
            .when(suffix.isNotNull(), hit("B", 0.75, "stem_with_suffix"))
            .when(low.isin(fixed.HOMOGRAPHS), hit(None, 0.0, "homograph"))
            .when(low.isin(fixed.ROMANISED), hit("A", 0.9, "romanised"))
            .otherwise(hit(None, 0.0, "latin"))
        )

    def parts(q):
        stem, suffix = split_suffix(q["low"])
        return F.struct(q["s"].alias("s"), script_of(q["s"]).alias("script"), q["low"].alias("low"), stem.alias("stem"), suffix.alias("suffix"))

    s = F.trim(token)
    low = F.regexp_replace(F.lower(s), r"""^[.,!?;:'"]+|[.,!?;:'"]+$""", "")
    return let(F.struct(s.alias("s"), low.alias("low")), lambda q: let(parts(q), rules))


def foreign_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[{fixed.FOREIGN_BLOCKS}]"), 0)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 when both are empty, 0 when one is."""
    return (
        F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )


def exact_match(a: Column, e: Column) -> Column:
    return (a == e).cast("double")


def entity_match(a: Column, e: Column) -> Column:
    """Containment, else share of expected words contained, else best fuzzy word (over 3 letters). Inputs normalised."""
    parts = F.split(e, " ")
    share = F.size(F.filter(parts, lambda w: F.contains(a, w))) / F.size(parts)
    best = F.array_max(F.transform(F.split(a, " "), lambda t: similarity(e, t)))
    return (
        F.when((a == "") | (e == ""), F.lit(0.0)).when(F.contains(a, e), F.lit(1.0))
        .when(F.size(parts) > 1, share).when(F.length(e) > 3, best).otherwise(F.lit(0.0))
    )


def phonetic_key(text: Column) -> Column:
    """Coarse sound key of a normalised text: fold spellings in order, drop doubles, keep a-z."""
    out = text
    for src, dst in fixed.FOLDINGS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.regexp_replace(F.regexp_replace(out, r"(.)\1+", "$1"), "[^a-z]", "")


def phonetic_match(a_key: Column, e_key: Column) -> Column:
    """Best similarity of the expected key to the whole answer key or any window of its length."""
    n = F.length(e_key)
    windows = F.transform(
        F.sequence(F.lit(1), F.length(a_key) - n + 1), lambda i: similarity(F.substring(a_key, i, n), e_key)
    )
    return (
        F.when((a_key == "") | (e_key == ""), F.lit(0.0))
        .when(F.length(a_key) <= n, similarity(a_key, e_key))
        .otherwise(F.greatest(similarity(a_key, e_key), F.array_max(windows)))
    )


def slug(value: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(value), r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def _as_characters(words: Column, vocabulary: Column) -> Column:
    """A text with one character for each word: its place in the vocabulary, counted from U+10000."""
    one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0xFFFF), 8, "0")), "UTF-32")
    return F.array_join(F.transform(words, one), "")


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance over words: words of a pair are coded as characters for the built-in distance, whose memory is linear."""
    return let(F.array_distinct(F.concat(ref, hyp)), lambda v: F.levenshtein(_as_characters(ref, v), _as_characters(hyp, v)))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    return (
        F.when((F.size(ref) == 0) & (F.size(hyp) == 0), F.lit(0.0)).when(F.size(ref) == 0, F.lit(1.0))
        .otherwise(word_distance(ref, hyp) / F.size(ref))
    )
