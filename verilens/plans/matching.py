"""Text labelling and answer-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilens.functions import text as X
from verilens.functions import words as fixed
from verilens.functions.arrays import compute_once
from verilens.operators import corpus as H
from verilens.operators import matching as K
from verilens.plans import sqlviews as Q
from verilens.plans.registry import query
from verilens.sources import views
from verilens.sources.tables import spread, table
from verilens.sources.held import hold


def words_of(spark, sf):
    """Distinct token spellings with their counts: labels are a function of the spelling, so each is computed once."""
    return views.tokens(spark, sf).groupBy(F.col("text").alias("token")).agg(F.count("*").alias("n"))


_W = Q.TOK + ", w AS (SELECT text AS token, count(*) AS n FROM tok GROUP BY ALL)"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in dict.fromkeys(xs)) + ")"


@query("script_of", "token n:l script", f"WITH {_W} SELECT token, n, CASE WHEN regexp_matches(token, '\\p{{Latin}}') THEN 'latin' ELSE 'none' END AS script FROM w")
def script_of(spark, sf):
    return words_of(spark, sf).withColumn("script", X.script_of(F.col("token")))


@query("suffix_split", "token n:l stem suffix", f"""WITH {_W}, s AS (SELECT *, regexp_extract(token, '^(.+)-([^-]*)$', 1) AS st, regexp_extract(token, '^(.+)-([^-]*)$', 2) AS tl FROM w)
 SELECT token, n, CASE WHEN st <> '' AND lower(tl) IN {_LIST(fixed.SUFFIXES)} THEN st ELSE token END AS stem, CASE WHEN st <> '' AND lower(tl) IN {_LIST(fixed.SUFFIXES)} THEN tl END AS suffix FROM s""")
def suffix_split(spark, sf):
    stem, suffix = X.split_suffix(F.col("token"))
    return words_of(spark, sf).select("token", "n", stem.alias("stem"), suffix.alias("suffix"))


@query("rule_labels", "token n:l lang conf:d reason", f"""WITH {_W}, t AS (SELECT *, regexp_replace(lower(token), '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g') AS low FROM w),
 s AS (SELECT *, regexp_extract(low, '^(.+)-([^-]*)$', 1) AS st, lower(regexp_extract(low, '^(.+)-([^-]*)$', 2)) AS tl FROM t),
 r AS (SELECT token, n, CASE WHEN regexp_matches(token, '^[^\\p{{L}}\\p{{N}}_]+$') THEN 'punctuation' WHEN regexp_matches(token, '^[\\p{{Nd}}.,:/-]+$') THEN 'numeric'
  WHEN NOT regexp_matches(token, '\\p{{Latin}}') THEN 'no_letters' WHEN st <> '' AND tl IN {_LIST(fixed.SUFFIXES)} THEN CASE WHEN st IN {_LIST(fixed.ROMANISED)} THEN 'romanised_with_suffix' ELSE 'stem_with_suffix' END
  WHEN low IN {_LIST(fixed.HOMOGRAPHS)} THEN 'homograph' WHEN low IN {_LIST(fixed.ROMANISED)} THEN 'romanised' ELSE 'latin' END AS reason FROM s)
 SELECT token, n, reason, CASE reason WHEN 'punctuation' THEN 'NEUTRAL' WHEN 'numeric' THEN 'NEUTRAL' WHEN 'no_letters' THEN 'NEUTRAL' WHEN 'romanised_with_suffix' THEN 'A' WHEN 'stem_with_suffix' THEN 'B' WHEN 'romanised' THEN 'A' END AS lang,
 CASE reason WHEN 'romanised_with_suffix' THEN 0.9 WHEN 'stem_with_suffix' THEN 0.75 WHEN 'romanised' THEN 0.9 WHEN 'homograph' THEN 0.0 WHEN 'latin' THEN 0.0 ELSE 1.0 END AS conf FROM r""")
def rule_labels(spark, sf):
    return words_of(spark, sf).withColumn("r", X.rule_cascade(F.col("token"))).select("token", "n", "r.*")


@query("resolution_rate", "speaker n:l resolved:l rate:d", f"""WITH {_W}, x AS (SELECT token FROM w WHERE NOT regexp_matches(token, '\\p{{Latin}}') OR (lower(token) IN {_LIST(fixed.ROMANISED)} AND lower(token) NOT IN {_LIST(fixed.HOMOGRAPHS)})
 OR (regexp_extract(token, '^(.+)-([^-]*)$', 1) <> '' AND lower(regexp_extract(token, '^(.+)-([^-]*)$', 2)) IN {_LIST(fixed.SUFFIXES)}))
 SELECT speaker, count(*) AS n, count(x.token) AS resolved, count(x.token) / count(*)::DOUBLE AS rate FROM tok LEFT JOIN x ON x.token = tok.text GROUP BY ALL""")
def resolution_rate(spark, sf):
    """Share of a speaker's tokens settled by rules alone."""
    n = views.tokens(spark, sf).groupBy("speaker", "text").agg(F.count("*").alias("n")).transform(hold)
    known = n.select("text").distinct().filter(X.rule_cascade(F.col("text"))["lang"].isNotNull()).withColumn("ok", F.lit(True))  # the rules run once a spelling
    t = n.join(known, "text", "left").withColumn("ok", F.col("ok").isNotNull())
    return t.groupBy("speaker").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("resolved")).withColumn("rate", F.col("resolved") / F.col("n"))


@query("looks_translated", "utt:l n_words:l", f"""WITH {Q.UTT}, w AS (SELECT utt, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS ws FROM utt WHERE doc_lang = 'de' AND trim(text) <> '' AND NOT regexp_matches(text, '[ß]'))
 SELECT utt, len(ws) AS n_words FROM w WHERE len(ws) > 0 AND NOT list_has_any(ws, ['der', 'un', 'en'])""")
def looks_translated(spark, sf):
    """Declared in one language, yet without its script and without any of its known words."""
    u = views.utterances(spark, sf).filter((F.col("doc_lang") == "de") & (F.trim("text") != "") & ~F.col("text").rlike("[ß]"))
    w = compute_once(u, ["utt"], w=F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    known = F.array(*[F.lit(x) for x in ("der", "un", "en")])
    return w.filter((F.size("w") > 0) & ~F.arrays_overlap("w", known)).select("utt", F.size("w").alias("n_words"))


@query("normalise_text", "doc_id:l n:l digest", f"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}_\\x{{0B80}}-\\x{{0BFF}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
 SELECT doc_id, length(t) AS n, md5(t) AS digest FROM n""")
def normalise_text(spark, sf):
    """NFC, lower case, punctuation to single spaces. Only texts NFC can change go through the Arrow function."""
    d = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    plain = d.filter(~X.needs_nfc(F.col("text")))
    fixed_up = d.filter(X.needs_nfc(F.col("text"))).select("doc_id", X.nfc(F.col("text")).alias("text"))
    n = compute_once(plain.unionByName(fixed_up), ["doc_id"], t=X.normalise(F.col("text")))
    return n.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


_LF = """wf AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
 lf AS (SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: regexp_matches(x, '\\p{Latin}'))) / len(ws)::DOUBLE ELSE 0 END AS f FROM wf)"""


@query("latin_fraction", "doc_id:l n:l fraction:d comparable:b", f"WITH {_LF} SELECT doc_id, n, f AS fraction, abs(f - (SELECT avg(f) FROM lf)) <= 0.5 AS comparable FROM lf")
def latin_fraction(spark, sf):
    """Share of Latin words of each text, and whether it is comparable with the mean of all texts."""
    d = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    w = compute_once(d, ["doc_id"], w=X.wer_words(F.col("text")))
    f = compute_once(w, ["doc_id"], n=F.size("w"), k=F.size(F.filter("w", X.is_latin))).withColumn("fraction", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)).transform(hold)
    m = f.agg(F.avg("fraction").alias("m"))  # one row
    return f.join(F.broadcast(m)).withColumn("comparable", F.abs(F.col("fraction") - F.col("m")) <= 0.5)


# Transcripts against references: the same words, swapped, with an insertion, in another script, or none.
_WER = """wr AS (SELECT p_partkey AS id, p_brand AS brand, lower(p_name || ' ' || p_type || ' steel box') AS ref, CASE p_partkey % 4 WHEN 0 THEN lower(p_name || ' ' || p_type || ' steel box') WHEN 1 THEN lower(p_type || ' ' || p_name || ' box')
 WHEN 2 THEN lower(p_name || ' uh ' || p_type || ' steel') ELSE CASE WHEN p_partkey % 8 = 3 THEN 'совсем другие слова steel' ELSE '' END END AS hyp FROM part)"""


def wer_pairs(spark, sf):
    p = spread(table(spark, sf, "part"), "p_partkey")
    name, kind, k = F.lower("p_name"), F.lower("p_type"), F.col("p_partkey") % 4
    sp = F.lit(" ")
    ref = F.concat(name, sp, kind, F.lit(" steel box"))
    hyp = F.when(k == 0, ref).when(k == 1, F.concat(kind, sp, name, F.lit(" box"))).when(k == 2, F.concat(name, F.lit(" uh "), kind, F.lit(" steel"))).when(F.col("p_partkey") % 8 == 3, "совсем другие слова steel").otherwise("")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), ref.alias("ref"), hyp.alias("hyp"))


def wer_rows(spark, sf):
    """Word error rate over all words and over Latin ones, and whether the two sides are in the same script often enough to compare."""
    w = compute_once(wer_pairs(spark, sf), ["id", "brand"], r=X.wer_words(F.col("ref")), h=X.wer_words(F.col("hyp")))
    w = compute_once(w, ["id", "brand", "r", "h"], rl=F.filter("r", X.is_latin), hl=F.filter("h", X.is_latin))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(0.0))
    return compute_once(w, ["id", "brand"], wer=X.word_error_rate(F.col("r"), F.col("h")), latin_wer=X.word_error_rate(F.col("rl"), F.col("hl")),
                        ref_latin=share("rl", "r"), hyp_latin=share("hl", "h")).withColumn("comparable", F.abs(F.col("ref_latin") - F.col("hyp_latin")) <= 0.5)


def _coded(words: str) -> str:
    """SQL for a text with one character a word."""
    return f"coalesce((SELECT string_agg(c, '' ORDER BY i) FROM (SELECT unnest({words}) AS w, generate_subscripts({words}, 1) AS i) JOIN vo USING (w)), '')"


def _rate(r: str, h: str) -> str:
    return f"CASE WHEN {r} = '' THEN ({h} <> '')::INT ELSE levenshtein({r}, {h}) / length({r})::DOUBLE END"


# Words become single characters, so character Levenshtein is word Levenshtein.
_WERC = _WER + f""", ws AS (SELECT id, brand, string_split(ref, ' ') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM wr),
 vo AS (SELECT w, chr((row_number() OVER (ORDER BY w) + 40)::INT) AS c FROM (SELECT DISTINCT unnest(list_concat(r, h)) AS w FROM ws)),
 wl AS (SELECT *, list_filter(r, lambda x: regexp_matches(x, '\\p{{Latin}}')) AS rl, list_filter(h, lambda x: regexp_matches(x, '\\p{{Latin}}')) AS hl FROM ws),
 en AS (SELECT *, {_coded('r')} AS rc, {_coded('h')} AS hc, {_coded('rl')} AS rlc, {_coded('hl')} AS hlc FROM wl),
 we AS (SELECT id, brand, {_rate('rc', 'hc')} AS wer, {_rate('rlc', 'hlc')} AS latin_wer, len(rl) / len(r)::DOUBLE AS ref_latin, CASE WHEN len(h) > 0 THEN len(hl) / len(h)::DOUBLE ELSE 0 END AS hyp_latin FROM en)"""


@query("wer", "id:l wer:d latin_wer:d", f"WITH {_WERC} SELECT * FROM we")
def wer(spark, sf):
    return wer_rows(spark, sf)


@query("transcripts_comparable", "id:l ref_latin:d hyp_latin:d comparable:b", f"WITH {_WERC} SELECT *, abs(ref_latin - hyp_latin) <= 0.5 AS comparable FROM we")
def transcripts_comparable(spark, sf):
    """Whether an error rate between two transcripts would mean anything: their shares of Latin words are near."""
    return wer_rows(spark, sf)


@query("wer_by_group", "brand n:l wer:d latin_wer:d not_comparable:l comparable_wer:d", f"""WITH {_WERC} SELECT brand, count(*) AS n, avg(wer) AS wer, avg(latin_wer) AS latin_wer, count(*) FILTER (abs(ref_latin - hyp_latin) > 0.5) AS not_comparable,
 avg(wer) FILTER (abs(ref_latin - hyp_latin) <= 0.5) AS comparable_wer FROM we GROUP BY ROLLUP (brand)""")
def wer_by_group(spark, sf):
    return wer_rows(spark, sf).rollup("brand").agg(F.count("*").alias("n"), F.avg("wer").alias("wer"), F.avg("latin_wer").alias("latin_wer"), F.count_if(~F.col("comparable")).alias("not_comparable"),
                                                   F.avg(F.when(F.col("comparable"), F.col("wer"))).alias("comparable_wer"))


# Answers to a stored value: verbatim, inside a sentence, misspelt, or something else.
_ANS = """an AS (SELECT p_partkey AS id, p_name AS expected, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN 'well, the ' || p_name || ' one' WHEN 2 THEN replace(replace(p_name, 'i', 'ee'), 'l', 'll') ELSE lower(p_type) END AS answer,
 p_partkey % 4 <> 3 AS should FROM part),
nm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(answer), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS a, lower(expected) AS e FROM an)"""


def answers(spark, sf):
    p = spread(table(spark, sf, "part"), "p_partkey")
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    a = F.when(k == 0, F.concat(F.upper(name), F.lit("!"))).when(k == 1, F.concat(F.lit("well, the "), name, F.lit(" one"))).when(
        k == 2, F.replace(F.replace(name, F.lit("i"), F.lit("ee")), F.lit("l"), F.lit("ll"))).otherwise(F.lower("p_type"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("expected"), a.alias("answer"), (k != 3).alias("should"))


def _fold(e):
    for s, d in fixed.FOLDINGS:
        e = f"replace({e}, '{s}', '{d}')"
    # DuckDB's regex has no back references: doubles are dropped letter by letter.
    return f"array_to_string(list_filter(string_split({e}, ''), lambda x, i: i = 1 OR x <> string_split({e}, '')[i - 1]), '')"


_SIM = "CASE WHEN {a} = '' AND {b} = '' THEN 1 WHEN {a} = '' OR {b} = '' THEN 0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
_MATCH = _ANS + f""", ky AS (SELECT *, regexp_replace({_fold('a')}, '[^a-z]', '', 'g') AS ak, regexp_replace({_fold('e')}, '[^a-z]', '', 'g') AS ek FROM nm),
mx AS (SELECT *, (a = e)::INT::DOUBLE AS exact, CASE WHEN contains(a, e) THEN 1 WHEN contains(e, ' ') THEN len(list_filter(string_split(e, ' '), lambda w: contains(a, w))) / len(string_split(e, ' '))::DOUBLE
  WHEN length(e) > 3 THEN list_max(list_transform(string_split(a, ' '), lambda t: {_SIM.format(a='e', b='t')})) ELSE 0 END AS entity,
 CASE WHEN ak = '' OR ek = '' THEN 0 WHEN length(ak) <= length(ek) THEN {_SIM.format(a='ak', b='ek')} ELSE greatest({_SIM.format(a='ak', b='ek')}, list_max(list_transform(range(1, length(ak) - length(ek) + 2), lambda i: {_SIM.format(a='substr(ak, i, length(ek))', b='ek')}))) END AS phonetic FROM ky),
ma AS (SELECT *, least(1, greatest(exact, entity, 0.95::DOUBLE * phonetic)) AS fused, CASE WHEN exact >= entity AND exact >= 0.95::DOUBLE * phonetic THEN 'exact' WHEN entity >= 0.95::DOUBLE * phonetic THEN 'entity' ELSE 'phonetic' END AS method FROM mx)"""


@query("similarity_ratio", "id:l ratio:d", f"WITH {_ANS} SELECT id, {_SIM.format(a='answer', b='expected')} AS ratio FROM nm")
def similarity_ratio(spark, sf):
    return answers(spark, sf).select("id", X.similarity(F.col("answer"), F.col("expected")).alias("ratio"))


@query("entity_match", "id:l entity:d", f"WITH {_MATCH} SELECT * FROM ma")
def entity_match(spark, sf):
    return K.match_scores(answers(spark, sf), "answer", "expected")


@query("phonetic_match", "id:l phonetic:d", f"WITH {_MATCH} SELECT * FROM ma")
def phonetic_match(spark, sf):
    return K.match_scores(answers(spark, sf), "answer", "expected")


@query("answer_match", "id:l fused:d method", f"WITH {_MATCH} SELECT * FROM ma")
def answer_match(spark, sf):
    return K.match_scores(answers(spark, sf), "answer", "expected")


@query("compare_matchers", "matcher n:l accuracy:d frr:d far:d", f"""WITH {_MATCH}, u AS (SELECT 'exact' AS matcher, should, exact >= 0.7 AS ok FROM ma UNION ALL SELECT 'entity', should, entity >= 0.7 FROM ma
 UNION ALL SELECT 'phonetic', should, phonetic >= 0.7 FROM ma UNION ALL SELECT 'fused', should, fused >= 0.7 FROM ma)
 SELECT matcher, count(*) AS n, avg((ok = should)::INT) AS accuracy, avg((NOT ok)::INT) FILTER (should) AS frr, avg(ok::INT) FILTER (NOT should) AS far FROM u GROUP BY ALL""")
def compare_matchers(spark, sf):
    m = K.match_scores(answers(spark, sf), "answer", "expected")
    u = m.select("should", F.expr("stack(4, 'exact', exact, 'entity', entity, 'phonetic', phonetic, 'fused', fused) AS (matcher, s)")).withColumn("ok", F.col("s") >= 0.7)
    i = F.col("ok").cast("int")
    return u.groupBy("matcher").agg(F.count("*").alias("n"), F.avg((F.col("ok") == F.col("should")).cast("int")).alias("accuracy"),
                                    F.avg(F.when(F.col("should"), 1 - i)).alias("frr"), F.avg(F.when(~F.col("should"), i)).alias("far"))


# Phrases: the 3rd, 6th and 10th word of a text (its last where it is shorter) in order, swapped when the id divides by 4, with a word that never occurs when it divides by 3. A text without words scores 0.
_PHR = Q.UTT + """, hd AS (SELECT utt, session, regexp_extract_all(lower(text), '\\p{L}+') AS h FROM utt),
h3 AS (SELECT *, h[least(3, len(h))] AS x, h[least(6, len(h))] AS y, h[least(10, len(h))] AS z FROM hd),
ex AS (SELECT *, CASE WHEN len(h) = 0 THEN [NULL, NULL, NULL] WHEN utt % 4 = 0 THEN [z, x, y] WHEN utt % 3 = 0 THEN [x, 'zzz', z] ELSE [x, y, z] END AS e FROM h3),
p1 AS (SELECT *, coalesce(list_position(h, e[1]), 0) AS a FROM ex), p2 AS (SELECT *, coalesce(list_position(h[a + 1:], e[2]), 0) AS b0 FROM p1),
p3 AS (SELECT *, CASE WHEN b0 > 0 THEN a + b0 ELSE a END AS b FROM p2), p4 AS (SELECT *, coalesce(list_position(h[b + 1:], e[3]), 0) AS c0 FROM p3),
ph AS (SELECT utt, session, (a > 0)::INT + (b0 > 0)::INT + (c0 > 0)::INT AS matched, ((a > 0)::INT + (b0 > 0)::INT + (c0 > 0)::INT) / 3.0::DOUBLE AS score,
 array_to_string(list_filter([CASE WHEN a = 0 THEN e[1] END, CASE WHEN b0 = 0 THEN e[2] END, CASE WHEN c0 = 0 THEN e[3] END], lambda x: x IS NOT NULL), ',') AS missing FROM p4)"""


def phrases(spark, sf):
    u = compute_once(views.utterances(spark, sf), ["utt", "session"], heard=F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    w = lambda i: F.get("heard", F.least(F.lit(i), F.size("heard")) - 1)
    e = F.when(F.size("heard") == 0, F.array().cast("array<string>")).when(F.col("utt") % 4 == 0, F.array(w(10), w(3), w(6))).when(F.col("utt") % 3 == 0, F.array(w(3), F.lit("zzz"), w(10))).otherwise(F.array(w(3), w(6), w(10)))
    return u.withColumn("expected", e)


def phrase_rows(p, close=None):
    r = compute_once(p, ["utt", "session", "expected"], r=K.phrase_hits(F.col("expected"), F.col("heard"), close))
    return r.select("utt", "session", F.size("r.hits").alias("matched"), F.coalesce(F.try_divide(F.size("r.hits"), F.size("expected")), F.lit(0.0)).alias("score"), F.col("r.missing").alias("_m"), F.concat_ws(",", "r.missing").alias("missing"))


@query("phrase_match", "utt:l matched:l score:d missing", f"WITH {_PHR} SELECT * FROM ph")
def phrase_match(spark, sf):
    """Expected words found in order, exact path."""
    return phrase_rows(phrases(spark, sf))


def _blocks(rounds: int) -> str:
    """CTEs: ``nr`` (w, h) of word pairs whose matching-block ratio is at least 0.8.

    A round takes the longest common block of every open segment (the first of
    equally long ones) and opens what is left and right of it.
    """
    parts = ["s0 AS (SELECT w, h, 1 AS al, length(w) + 1 AS ah, 1 AS bl, length(h) + 1 AS bh FROM pr)"]
    for r in range(rounds):
        parts.append(f"""g{r} AS (SELECT w, h, al, ah, bl, bh, i, j, len([1 FOR k IN range(1, least(ah - i, bh - j) + 1) IF substr(w, i, k) = substr(h, j, k)]) AS k
  FROM (SELECT *, unnest(range(bl, bh)) AS j FROM (SELECT *, unnest(range(al, ah)) AS i FROM s{r}))),
 m{r} AS (SELECT w, h, al, ah, bl, bh, arg_max({{'i': i, 'j': j, 'k': k}}, (k, -i, -j)) AS m FROM g{r} WHERE k > 0 GROUP BY ALL),
 s{r + 1} AS (SELECT w, h, al, m.i AS ah, bl, m.j AS bh FROM m{r} WHERE m.i > al AND m.j > bl UNION ALL SELECT w, h, m.i + m.k, ah, m.j + m.k, bh FROM m{r} WHERE ah > m.i + m.k AND bh > m.j + m.k)""")
    found = " UNION ALL ".join(f"SELECT w, h, m.k AS k FROM m{r}" for r in range(rounds))
    parts.append(f"nr AS (SELECT w, list(h) AS hs FROM (SELECT w, h FROM ({found}) GROUP BY w, h HAVING 2 * sum(k) / (length(w) + length(h))::DOUBLE >= 0.8) GROUP BY w)")
    return ",\n ".join(parts)


def _at(e: str, near: str, rest: str) -> str:
    """SQL for the first place of a word, or one near it, in a list; 0 without."""
    return f"coalesce(list_position([x = {e} OR coalesce(list_contains({near}, x), false) FOR x IN {rest}], true), 0)"


_FUZ = _PHR[:_PHR.index("p1 AS (")] + f"""ef AS (SELECT utt, session, h, [CASE WHEN length(w) > 5 THEN w || 's' ELSE w END FOR w IN e] AS e FROM ex),
 pr AS (SELECT DISTINCT w, h FROM (SELECT w, unnest(list_distinct(h)) AS h FROM (SELECT unnest(e) AS w, h FROM ef)) WHERE w <> h AND 2 * least(length(w), length(h)) / (length(w) + length(h))::DOUBLE >= 0.8),
 {_blocks(8)},
 ec AS (SELECT ef.*, n1.hs AS c1, n2.hs AS c2, n3.hs AS c3 FROM ef LEFT JOIN nr n1 ON n1.w = e[1] LEFT JOIN nr n2 ON n2.w = e[2] LEFT JOIN nr n3 ON n3.w = e[3]),
 f1 AS (SELECT *, {_at('e[1]', 'c1', 'h')} AS a FROM ec), f2 AS (SELECT *, {_at('e[2]', 'c2', 'h[a + 1:]')} AS b0 FROM f1), f3 AS (SELECT *, CASE WHEN b0 > 0 THEN a + b0 ELSE a END AS b FROM f2),
 f4 AS (SELECT *, {_at('e[3]', 'c3', 'h[b + 1:]')} AS c0 FROM f3),
 pf AS (SELECT utt, (a > 0)::INT + (b0 > 0)::INT + (c0 > 0)::INT AS matched, ((a > 0)::INT + (b0 > 0)::INT + (c0 > 0)::INT) / 3.0::DOUBLE AS score,
 array_to_string(list_filter([CASE WHEN a = 0 THEN e[1] END, CASE WHEN b0 = 0 THEN e[2] END, CASE WHEN c0 = 0 THEN e[3] END], lambda x: x IS NOT NULL), ',') AS missing FROM f4)"""


@query("phrase_match_fuzzy", "utt:l matched:l score:d missing", f"WITH {_FUZ} SELECT * FROM pf")
def phrase_match_fuzzy(spark, sf):
    """The same with close spellings accepted (matching-block ratio of at least 0.8)."""
    p = phrases(spark, sf).withColumn("expected", F.transform("expected", lambda w: F.when(F.length(w) > 5, F.concat(w, F.lit("s"))).otherwise(w)))
    return phrase_rows(K.with_close_words(p.transform(hold), "utt"), F.col("close"))


@query("phrase_pass_rate", "session:l n:l pass_rate:d pass_all:d top_missing", f"""WITH {_PHR}, ms AS (SELECT session, unnest(string_split(missing, ',')) AS w FROM ph WHERE missing <> ''), mc AS (SELECT session, w, count(*) AS k FROM ms GROUP BY ALL)
 SELECT session, count(*) AS n, avg((score >= 0.6)::INT) AS pass_rate, avg((score >= 1)::INT) AS pass_all, (SELECT arg_min(w, (-k, w)) FROM mc WHERE mc.session = ph.session) AS top_missing FROM ph GROUP BY ALL""")
def phrase_pass_rate(spark, sf):
    r = phrase_rows(phrases(spark, sf)).transform(hold)
    top = r.select("session", F.explode("_m").alias("w")).groupBy("session", "w").agg(F.count("*").alias("k")).groupBy("session").agg(F.min(F.struct((-F.col("k")).alias("k"), "w")).alias("t"))
    s = r.groupBy("session").agg(F.count("*").alias("n"), F.avg((F.col("score") >= 0.6).cast("int")).alias("pass_rate"), F.avg((F.col("score") >= 1).cast("int")).alias("pass_all"))
    return s.join(top, "session", "left").withColumn("top_missing", F.col("t.w"))


@query("fuzzy_vocab_pairs", "a b ratio:d", r"""WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM benchmark)),
 o AS (SELECT string_agg(c, '' ORDER BY c) AS letters, count(*)::INT AS n FROM (SELECT DISTINCT c FROM (SELECT unnest(string_split(w, '')) AS c FROM v) WHERE c > '~')),
 s AS (SELECT w, translate(w, letters, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~', 1, n)) AS k FROM v, o)
 SELECT x.w AS a, y.w AS b, 1 - levenshtein(x.k, y.k) / greatest(length(x.k), length(y.k))::DOUBLE AS ratio FROM s x JOIN s y ON x.w < y.w AND 1 - levenshtein(x.k, y.k) / greatest(length(x.k), length(y.k))::DOUBLE >= 0.8 - 1e-9""")
def fuzzy_vocab_pairs(spark, sf):
    """Words of a vocabulary that come within fuzzy reach of one another. (The SQL maps other letters to single bytes, which its distance counts.)"""
    b = spread(table(spark, sf, "benchmark"), "item_id").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return K.fuzzy_pairs(b.select(F.lower("w").alias("word")).distinct())


@query("probe_windows", "doc_id:l piece:l n:l digest", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), w AS (SELECT doc_id, unnest(range(0, greatest(n, 1), 400)) AS s, text, n FROM d)
 SELECT doc_id, s // 400 AS piece, length(substr(text, s + 1, 400)) AS n, md5(substr(text, s + 1, 400)) AS digest FROM w WHERE length(substr(text, s + 1, 400)) >= 240 OR n < 400""")
def probe_windows(spark, sf):
    """Fixed-length pieces of a text; a tail is kept from 60% of the length on, a short whole counts once."""
    d = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", "text", F.length("text").alias("len"))
    w = d.select("doc_id", "text", "len", F.explode(F.sequence(F.lit(0), F.greatest(F.col("len") - 1, F.lit(0)), F.lit(400))).alias("s"))
    p = w.select("doc_id", "len", F.floor(F.col("s") / 400).alias("piece"), F.col("text").substr(F.col("s") + 1, F.lit(400)).alias("p"))
    return p.select("doc_id", "piece", "len", F.length("p").alias("n"), F.md5("p").alias("digest")).filter("n >= 240 or len < 400")


@query("clip_enrichment", "doc_id:l duplicate:b looped:b foreign_mark:b flags", f"""WITH {Q.TOK}, c AS (SELECT utt, lower(text) AS w, count(*) AS n FROM tok WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL),
 lp AS (SELECT utt FROM c GROUP BY ALL HAVING sum(n) >= 12 AND max(n) / sum(n)::DOUBLE >= 0.25), f AS (SELECT text, min(doc_id) AS fd FROM documents GROUP BY ALL)
 SELECT doc_id, doc_id <> fd AS duplicate, doc_id IN (SELECT utt FROM lp) AS looped, regexp_matches(documents.text, '[üß]') AS foreign_mark,
 array_to_string(list_filter([CASE WHEN doc_id <> fd THEN 'duplicate' END, CASE WHEN doc_id IN (SELECT utt FROM lp) THEN 'loop' END, CASE WHEN regexp_matches(documents.text, '[üß]') THEN 'foreign' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents JOIN f ON f.text = documents.text""")
def clip_enrichment(spark, sf):
    """Flags of each item from several measurements, joined on the item."""
    from verilens.plans.corpus import exact_dups, repetition_loop

    d = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("text").rlike("[üß]").alias("foreign_mark"))
    j = d.join(exact_dups(spark, sf).select("doc_id", F.lit(True).alias("duplicate")), "doc_id", "left").join(
        repetition_loop(spark, sf).select("doc_id", F.lit(True).alias("looped")), "doc_id", "left")
    j = j.select("doc_id", "foreign_mark", F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.coalesce("looped", F.lit(False)).alias("looped"))
    return j.withColumn("flags", F.concat_ws(",", F.array_compact(F.array(F.when(F.col("duplicate"), "duplicate"), F.when(F.col("looped"), "loop"), F.when(F.col("foreign_mark"), "foreign")))))
