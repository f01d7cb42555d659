"""Token, behaviour-graph and log-likelihood-ratio queries over `documents`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verilens.functions import text as X
from verilens.functions.arrays import compute_once, let
from verilens.functions.stats import jsd2
from verilens.operators import curves as C
from verilens.operators import graph as G
from verilens.operators import llr as L
from verilens.operators import splits as S
from verilens.operators import tokens as T
from verilens.operators.pairs import each_with_each
from verilens.operators.scan import exact_quantiles
from verilens.plans import sqlviews as Q
from verilens.plans.registry import query
from verilens.sources import views
from verilens.sources.held import hold


def toks(spark, sf):
    return views.token_arrays(spark, sf)


def choices(spark, sf):
    return views.choice_words(spark, sf)


def graph_counts(spark, sf):
    """21 rows a speaker, read several times by most queries and therefore persisted."""
    return G.dense(G.word_cells(choices(spark, sf), ["speaker"]), ["speaker"]).transform(hold)


def graphs(spark, sf):
    return G.smooth(graph_counts(spark, sf), ["speaker"])


@query("tokenise", "utt:l n_tokens:l n_chars:l", f"""WITH {Q.TOK} SELECT u.utt, count(t.pos) AS n_tokens,
 coalesce(sum(length(t.text)), 0) AS n_chars FROM utt u LEFT JOIN tok t USING (utt) GROUP BY u.utt""")
def tokenise(spark, sf):
    u = views.utterances(spark, sf).withColumn("w", X.tokenise(F.col("text")))
    return u.select("utt", F.size("w").alias("n_tokens"), F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x)).alias("n_chars"))


@query("choice_tokens", "speaker lang n:l n_confident:l", f"""WITH {Q.TOK} SELECT speaker, lang, count(*) AS n,
 count(*) FILTER (conf >= 0.8) AS n_confident FROM tok WHERE lang IN ('A', 'B') GROUP BY ALL""")
def choice_tokens(spark, sf):
    t = views.tokens(spark, sf).filter(T.is_choice(F.col("lang")))
    return t.groupBy("speaker", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("conf") >= 0.8).alias("n_confident"))


@query("lexical_counts", "speaker cls lang n:l", f"""WITH {Q.GRAPH} SELECT speaker, cls, 'A' AS lang, n_a AS n FROM dn
 UNION ALL SELECT speaker, cls, 'B', n_b FROM dn""")
def lexical_counts(spark, sf):
    return graph_counts(spark, sf).select("speaker", "cls", F.expr("stack(2, 'A', n_a, 'B', n_b) AS (lang, n)"))


_TR = " UNION ALL ".join(f"SELECT speaker, cls, '{p}' AS prev, '{n}' AS lang, {c} AS n FROM dn"
                         for p, n, c in (("A", "A", "t_aa"), ("A", "B", "t_ab"), ("B", "A", "t_ba"), ("B", "B", "t_bb")))


@query("transition_counts", "speaker cls prev lang n:l", f"WITH {Q.GRAPH} {_TR}")
def transition_counts(spark, sf):
    return graph_counts(spark, sf).select(
        "speaker", "cls", F.expr("stack(4, 'A','A',t_aa, 'A','B',t_ab, 'B','A',t_ba, 'B','B',t_bb) AS (prev, lang, n)"))


@query("csbg_lexical", "speaker cls n_a:l n_b:l marginal:d p_a:d p_b:d", f"WITH {Q.GRAPH} SELECT *, 1 - p_a AS p_b FROM gr")
def csbg_lexical(spark, sf):
    return graphs(spark, sf).withColumn("p_b", 1 - F.col("p_a"))


@query("csbg_transition", "speaker cls prev p_a:d p_b:d", f"""WITH {Q.GRAPH} SELECT speaker, cls, 'A' AS prev, pt_a AS p_a, 1 - pt_a AS p_b FROM gr
 UNION ALL SELECT speaker, cls, 'B', pt_b, 1 - pt_b FROM gr""")
def csbg_transition(spark, sf):
    return graphs(spark, sf).select("speaker", "cls", F.expr("stack(2, 'A', pt_a, 1 - pt_a, 'B', pt_b, 1 - pt_b) AS (prev, p_a, p_b)"))


def speaker_mix(spark, sf):
    """One row a speaker, persisted."""
    return T.mixing(T.sequence_stats(choices(spark, sf)), ["speaker"]).transform(hold)


@query("mixing_metrics", "speaker n_tokens:l n_choice:l n_switches:l cmi:d m_index:d i_index:d first_share:d",
       f"""WITH {Q.CHOICE}, {Q.mixing('ch', 'utt', 'speaker', 'mx')} SELECT mx.*, n_tokens FROM mx
       JOIN (SELECT speaker, count(*) AS n_tokens FROM tok GROUP BY ALL) USING (speaker)""")
def mixing_metrics(spark, sf):
    return speaker_mix(spark, sf)


@query("burstiness", "speaker n_runs:l burstiness:d", f"WITH {Q.CHOICE}, {Q.mixing('ch', 'utt', 'speaker', 'mx')} SELECT * FROM mx")
def burstiness(spark, sf):
    return speaker_mix(spark, sf)


_BG = Q.GRAPH + f""", bgc AS (SELECT 'all' AS pool, cls, ord, sup, low, elicitable, {", ".join(f"sum({c}) AS {c}" for c in Q.COUNTS)} FROM dn GROUP BY ALL),
{Q.smooth('bgc', 'pool', 'bg')}"""


@query("background_model", "cls n_a:l n_b:l p_a:d pt_a:d pt_b:d", f"WITH {_BG} SELECT * FROM bg")
def background_model(spark, sf):
    return G.smooth(G.background(graph_counts(spark, sf)).withColumn("pool", F.lit("all")), ["pool"])


_LOO = Q.GRAPH + ", " + Q.loo("dn", "speaker", "lo") + ", " + Q.smooth("lo", "speaker", "lb")


@query("loo_background", "speaker cls n_a:l n_b:l t_aa:l t_bb:l p_a:d", f"WITH {_LOO} SELECT * FROM lb")
def loo_background(spark, sf):
    return G.smooth(G.leave_one_out(graph_counts(spark, sf), "speaker"), ["speaker"])


@query("graph_profile", "speaker total:l density:d n_observed:l observed sparse dominant",
       f"""WITH {Q.GRAPH} SELECT speaker, sum(n_a + n_b) AS total, count(*) FILTER (n_a + n_b >= 5) / 21.0 AS density,
 count(*) FILTER (n_a + n_b >= 1) AS n_observed, string_agg(cls, ',' ORDER BY n_a + n_b DESC, ord) FILTER (n_a + n_b >= 1) AS observed,
 coalesce(string_agg(cls, ',' ORDER BY ord) FILTER (n_a + n_b < 5), '') AS sparse,
 string_agg(CASE WHEN p_a >= 1 - p_a THEN 'A' ELSE 'B' END, '' ORDER BY ord) AS dominant FROM gr GROUP BY ALL""")
def graph_profile(spark, sf):
    n = F.col("n_a") + F.col("n_b")

    def names(order, cond, value):
        rows = F.sort_array(F.collect_list(F.when(cond, F.struct(*order, value.alias("v")))))
        return F.concat_ws(",", F.transform(rows, lambda r: r["v"]))

    g = graphs(spark, sf).groupBy("speaker").agg(  # 21 rows per speaker
        F.sum(n).alias("total"), (F.count_if(n >= 5) / 21.0).alias("density"), F.count_if(n >= 1).alias("n_observed"),
        names([(-n).alias("a"), F.col("ord")], n >= 1, F.col("cls")).alias("observed"),
        names([F.col("ord")], n < 5, F.col("cls")).alias("sparse"),
        F.replace(names([F.col("ord")], F.lit(True), F.when(F.col("p_a") >= 1 - F.col("p_a"), "A").otherwise("B")), F.lit(",")).alias("dominant"),
    )
    return g


@query("class_weights", "speaker cls weight:d", f"""WITH {Q.GRAPH} SELECT speaker, cls, CASE WHEN sum(n_a + n_b) OVER w > 0
 THEN (n_a + n_b) / (sum(n_a + n_b) OVER w)::DOUBLE ELSE 1 / (count(*) OVER w)::DOUBLE END AS weight FROM dn WHERE NOT low WINDOW w AS (PARTITION BY speaker)""")
def class_weights(spark, sf):
    w = Window.partitionBy("speaker")
    n = F.col("n_a") + F.col("n_b")
    total = F.sum(n).over(w)
    return graph_counts(spark, sf).filter("not low").select(
        "speaker", "cls", F.when(total > 0, n / total).otherwise(1 / F.count(F.lit(1)).over(w)).alias("weight"))


@query("speaker_consistency", "speaker consistency:d", f"""WITH {Q.GRAPH} SELECT speaker,
 coalesce(avg(2 * abs(p_a - 0.5)) FILTER (n_a + n_b >= 5 AND NOT low), 0) AS consistency FROM gr GROUP BY ALL""")
def speaker_consistency(spark, sf):
    own = (F.col("n_a") + F.col("n_b") >= 5) & ~F.col("low")
    return graphs(spark, sf).groupBy("speaker").agg(F.coalesce(F.avg(F.when(own, 2 * F.abs(F.col("p_a") - 0.5))), F.lit(0.0)).alias("consistency"))


@query("csbg_matrix", "cls speaker p:d n:l", f"WITH {Q.GRAPH} SELECT cls, speaker, p_a AS p, n_a + n_b AS n FROM gr")
def csbg_matrix(spark, sf):
    return graphs(spark, sf).select("cls", "speaker", F.col("p_a").alias("p"), (F.col("n_a") + F.col("n_b")).alias("n"))


@query("class_share", "cls speaker share:d n:l thin:b", f"""WITH {Q.GRAPH} SELECT cls, speaker, n_a / nullif(n_a + n_b, 0)::DOUBLE AS share,
 n_a + n_b AS n, n_a + n_b < 5 AS thin FROM dn""")
def class_share(spark, sf):
    n = F.col("n_a") + F.col("n_b")
    return graph_counts(spark, sf).select("cls", "speaker", F.try_divide("n_a", n).alias("share"), n.alias("n"), (n < 5).alias("thin"))


# Jensen-Shannon divergence of two P(A) values, in bits.
_JSD = """greatest(0, least(1, 0.5 * (
 {a} * log2({a} / (({a} + {b}) / 2)) + {b} * log2({b} / (({a} + {b}) / 2))
 + (1 - {a}) * log2((1 - {a}) / ((2 - {a} - {b}) / 2)) + (1 - {b}) * log2((1 - {b}) / ((2 - {a} - {b}) / 2)))))"""


@query("graph_jsd", "speaker session:l next_session:l n_classes:l jsd:d", f"""WITH {Q.CHOICE}, {Q.CLS},
chs AS (SELECT * REPLACE (speaker || '/' || session AS speaker) FROM ch), {Q.cells('chs', 'speaker', 'cl')}, {Q.dense('cl', 'speaker', 'dn')}, {Q.smooth('dn', 'speaker', 'gr')},
g AS (SELECT split_part(speaker, '/', 1) AS spk, split_part(speaker, '/', 2)::BIGINT AS session, cls, n_a + n_b AS n, p_a, low FROM gr)
SELECT a.spk AS speaker, a.session, b.session AS next_session, count(*) AS n_classes,
 sum({_JSD.format(a='a.p_a', b='b.p_a')} * sqrt(a.n * b.n)) / sum(sqrt(a.n * b.n)) AS jsd
FROM g a JOIN g b ON a.spk = b.spk AND b.session = a.session + 1 AND a.cls = b.cls WHERE NOT a.low AND a.n >= 3 AND b.n >= 3 GROUP BY ALL""")
def graph_jsd(spark, sf):
    """Drift of a speaker's graph from one session to the next."""
    keys = ["speaker", "session"]
    g = G.smooth(G.dense(G.word_cells(choices(spark, sf), keys), keys), keys).transform(hold).filter("not low and n_a + n_b >= 3").select(
        *keys, "cls", (F.col("n_a") + F.col("n_b")).alias("n"), "p_a")
    nxt = g.select("speaker", "cls", (F.col("session") - 1).alias("session"), F.col("n").alias("n2"), F.col("p_a").alias("p2"))
    w = F.sqrt(F.col("n") * F.col("n2"))
    return g.join(nxt, ["speaker", "session", "cls"]).groupBy("speaker", "session").agg(
        F.count(F.lit(1)).alias("n_classes"), (F.sum(jsd2(F.col("p_a"), F.col("p2")) * w) / F.sum(w)).alias("jsd"),
    ).withColumn("next_session", F.col("session") + 1)


@query("discriminative_topk", "speaker cls rank:l jsd:d", f"""WITH {_LOO} SELECT * FROM (SELECT speaker, cls, jsd,
 row_number() OVER (PARTITION BY speaker ORDER BY round(jsd, 9) DESC, ord) AS rank FROM
 (SELECT g.speaker, g.cls, g.ord, {_JSD.format(a='g.p_a', b='b.p_a')} AS jsd FROM gr g JOIN lb b USING (speaker, cls) WHERE NOT g.low AND g.n_a + g.n_b >= 5)) WHERE rank <= 5""")
def discriminative_topk(spark, sf):
    counts = graph_counts(spark, sf)
    bg = G.smooth(G.leave_one_out(counts, "speaker"), ["speaker"]).select("speaker", "cls", F.col("p_a").alias("q"))
    d = G.smooth(counts, ["speaker"]).filter("not low and n_a + n_b >= 5").join(bg, ["speaker", "cls"]).select(
        "speaker", "cls", "ord", jsd2(F.col("p_a"), F.col("q")).alias("jsd"))
    return S.rank_first(d, ["speaker"], [F.round("jsd", 9).desc(), "ord"], 5).withColumnRenamed("rn", "rank")


@query("style_profile", "speaker cmi:d burstiness:d n_classes:l profile", f"""WITH {Q.GRAPH}, {Q.mixing('ch', 'utt', 'speaker', 'mx')}
SELECT speaker, any_value(cmi) AS cmi, any_value(burstiness) AS burstiness, count(*) FILTER (n_a + n_b >= 3) AS n_classes,
 string_agg(cls || '=' || CASE WHEN p_a >= 1 - p_a THEN 'A' ELSE 'B' END, ',' ORDER BY ord) FILTER (n_a + n_b >= 3) AS profile
FROM gr JOIN mx USING (speaker) GROUP BY ALL""")
def style_profile(spark, sf):
    seen = F.col("n_a") + F.col("n_b") >= 3
    label = F.concat("cls", F.lit("="), F.when(F.col("p_a") >= 1 - F.col("p_a"), "A").otherwise("B"))
    rows = F.sort_array(F.collect_list(F.when(seen, F.struct("ord", label.alias("v")))))
    p = graphs(spark, sf).groupBy("speaker").agg(F.count_if(seen).alias("n_classes"), F.concat_ws(",", F.transform(rows, lambda r: r["v"])).alias("profile"))
    return p.join(speaker_mix(spark, sf), "speaker")


@query("graph_nodes", "speaker id kind n:l sparse:b", f"""WITH {Q.GRAPH} SELECT speaker, cls AS id, 'class' AS kind, n_a + n_b AS n, n_a + n_b < 5 AS sparse FROM dn WHERE n_a + n_b >= 1
 UNION ALL SELECT speaker, 'A', 'language', sum(n_a), false FROM dn GROUP BY ALL UNION ALL SELECT speaker, 'B', 'language', sum(n_b), false FROM dn GROUP BY ALL""")
def graph_nodes(spark, sf):
    n = F.col("n_a") + F.col("n_b")
    g = graph_counts(spark, sf)
    cls = g.filter(n >= 1).select("speaker", F.col("cls").alias("id"), F.lit("class").alias("kind"), n.alias("n"), (n < 5).alias("sparse"))
    lang = g.groupBy("speaker").agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b")).select(
        "speaker", F.expr("stack(2, 'A', a, 'B', b) AS (id, n)")).select("speaker", "id", F.lit("language").alias("kind"), "n", F.lit(False).alias("sparse"))
    return cls.unionByName(lang)


_EDGES = " UNION ALL ".join(
    [f"SELECT speaker, cls AS src, '{x}' AS dst, 'lexical' AS type, {p} AS p, {c} AS n FROM gr WHERE n_a + n_b >= 1" for x, p, c in (("A", "p_a", "n_a"), ("B", "1 - p_a", "n_b"))]
    + [f"SELECT speaker, cls || ':{x}', '{y}', 'transition', {p}, {c} FROM gr WHERE {c} >= 1" for x, y, p, c in
       (("A", "A", "pt_a", "t_aa"), ("A", "B", "1 - pt_a", "t_ab"), ("B", "A", "pt_b", "t_ba"), ("B", "B", "1 - pt_b", "t_bb"))])


@query("graph_edges", "speaker src dst type p:d n:l", f"WITH {Q.GRAPH} {_EDGES}")
def graph_edges(spark, sf):
    def edge(src, dst, kind, p, n, cond):
        return F.when(cond, F.struct(src.alias("src"), F.lit(dst).alias("dst"), F.lit(kind).alias("type"), p.alias("p"), n.alias("n")))

    c = F.col
    seen = c("n_a") + c("n_b") >= 1
    out = [edge(c("cls"), "A", "lexical", c("p_a"), c("n_a"), seen), edge(c("cls"), "B", "lexical", 1 - c("p_a"), c("n_b"), seen)]
    for x, y, p, n in (("A", "A", c("pt_a"), "t_aa"), ("A", "B", 1 - c("pt_a"), "t_ab"), ("B", "A", c("pt_b"), "t_ba"), ("B", "B", 1 - c("pt_b"), "t_bb")):
        out.append(edge(F.concat(c("cls"), F.lit(":" + x)), y, "transition", p, c(n), c(n) >= 1))
    return graphs(spark, sf).select("speaker", F.inline(F.array_compact(F.array(*out))))


@query("corpus_profile", "speaker n_utts:l n_tokens:l n_choice:l first_share:d cmi:d i_index:d burstiness:d n_switches:l unreliable:b cmi_spread:d",
       f"""WITH {Q.CHOICE}, {Q.mixing('ch', 'utt', 'speaker', 'mx')} SELECT mx.*, n_tokens, n_utts, n_choice < 20 AS unreliable,
 max(cmi) OVER () - min(cmi) OVER () AS cmi_spread FROM mx JOIN (SELECT speaker, count(*) AS n_tokens FROM tok GROUP BY ALL) USING (speaker)
 JOIN (SELECT speaker, count(*) AS n_utts FROM utt GROUP BY ALL) USING (speaker)""")
def corpus_profile(spark, sf):
    m = speaker_mix(spark, sf)
    spread = m.agg((F.max("cmi") - F.min("cmi")).alias("cmi_spread"))  # one row
    return m.withColumn("unreliable", F.col("n_choice") < 20).join(F.broadcast(spread))


@query("share_collapse_audit", "utt:l speaker share:d median:d flagged:b", f"""WITH {Q.CHOICE},
s AS (SELECT utt, speaker, count(*) FILTER (lang = 'A') / count(*)::DOUBLE AS share FROM ch GROUP BY ALL HAVING count(*) >= 5),
m AS (SELECT speaker, quantile_cont(share, 0.5) AS median, count(*) AS n FROM s GROUP BY ALL)
SELECT utt, speaker, share, median, share <= 0.25 * median AS flagged FROM s JOIN m USING (speaker) WHERE n >= 4 AND median >= 0.15""")
def share_collapse_audit(spark, sf):
    s = T.sequence_stats(choices(spark, sf)).filter("n_choice >= 5").select("utt", "speaker", (F.col("n_first") / F.col("n_choice")).alias("share")).transform(hold)
    m = exact_quantiles(s, ["speaker"], "share", {"median": 0.5}).join(s.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")), "speaker")
    return s.join(m.filter("n >= 4 and median >= 0.15"), "speaker").withColumn("flagged", F.col("share") <= 0.25 * F.col("median"))


@query("class_coverage", "cls n_tokens:l n_speakers:l starved:b", f"""WITH {Q.GRAPH} SELECT cls, sum(n_a + n_b) AS n_tokens,
 count(*) FILTER (n_a + n_b >= 4) AS n_speakers, any_value(elicitable) AND count(*) FILTER (n_a + n_b >= 4) = 0 AS starved FROM dn GROUP BY ALL""")
def class_coverage(spark, sf):
    n = F.col("n_a") + F.col("n_b")
    return graph_counts(spark, sf).groupBy("cls").agg(
        F.sum(n).alias("n_tokens"), F.count_if(n >= 4).alias("n_speakers"), F.first("elicitable").alias("_e"),
    ).withColumn("starved", F.col("_e") & (F.col("n_speakers") == 0))


@query("prompt_coverage", "prompt:l n_utts:l mean_tokens:d hit_rate:d wrapperless:b", f"""WITH {Q.CHOICE},
p AS (SELECT u.utt, u.prompt, count(t.pos) AS n, coalesce(bool_or(t.cls = 'C' || (u.prompt + 8)), false) AS hit FROM utt u LEFT JOIN tok t USING (utt) GROUP BY ALL)
SELECT prompt, count(*) AS n_utts, avg(n) AS mean_tokens, avg(hit::INT) AS hit_rate, avg(n) < 5 AS wrapperless FROM p GROUP BY ALL""")
def prompt_coverage(spark, sf):
    t = toks(spark, sf)
    target = F.concat(F.lit("C"), F.col("prompt") + 8)
    per = t.select("prompt", F.size("toks").alias("n"), F.exists("toks", lambda x: x["cls"] == target).alias("hit"))
    return per.groupBy("prompt").agg(
        F.count(F.lit(1)).alias("n_utts"), F.avg("n").alias("mean_tokens"), F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    ).withColumn("wrapperless", F.col("mean_tokens") < 5)


# ---------------------------------------------------------------- scoring

def enrol_probe(spark, sf):
    cells = L.utterance_cells(choices(spark, sf))
    return cells.filter("session < 3"), cells.filter("session = 3")


def speaker_names(enrol, probe):
    return enrol.select(F.col("speaker").alias("k")).union(probe.select("speaker")).distinct()


def llr_streams(spark, sf, low_signal=False):
    enrol, probe = enrol_probe(spark, sf)
    return L.streams(probe, enrol, L.models(enrol), low_signal=low_signal)


def llr_parts(spark, sf):
    """Scored trials with their split part."""
    enrol, probe = enrol_probe(spark, sf)
    t = L.with_score(L.mix_streams(L.streams(probe, enrol, L.models(enrol))))
    return S.trial_parts(t, speakers=speaker_names(enrol, probe))


def llr_trials(spark, sf):
    return L.with_score(L.mix_streams(llr_streams(spark, sf)))


@query("llr_scores", "utt:l probe_speaker claimed n_scored:l lex:d trans:d met:d raw:d score:d", f"WITH {Q.LLR} SELECT * FROM lt")
def llr_scores(spark, sf):
    return llr_trials(spark, sf)


@query("trials_llr", "claimed is_genuine:b n:l n_unmeasured:l mean_raw:d", f"""WITH {Q.LLR} SELECT claimed, is_genuine, count(*) AS n,
 count(*) - count(score) AS n_unmeasured, avg(raw) AS mean_raw FROM lt GROUP BY ALL""")
def trials_llr(spark, sf):
    return llr_trials(spark, sf).groupBy("claimed", "is_genuine").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull()).alias("n_unmeasured"), F.avg("raw").alias("mean_raw"))


@query("llr_contributions", "utt:l claimed cls rank:l n:l llr:d expected expected_p:d observed observed_p:d jsd:d", f"""WITH {Q.LLR},
k AS (SELECT p.utt, p.speaker AS probe_speaker, m.speaker AS claimed, p.cls, m.ord, n_a + n_b AS n, n_a * l_a + n_b * l_b AS llr, p_a, n_a >= n_b AS obs_a, n_a / (n_a + n_b)::DOUBLE AS q
 FROM pcl p JOIN mo m USING (cls) WHERE NOT low AND n_a + n_b > 0)
SELECT * FROM (SELECT utt, claimed, cls, n, llr, CASE WHEN p_a >= 1 - p_a THEN 'A' ELSE 'B' END AS expected, greatest(p_a, 1 - p_a) AS expected_p,
 CASE WHEN obs_a THEN 'A' ELSE 'B' END AS observed, CASE WHEN obs_a THEN p_a ELSE 1 - p_a END AS observed_p,
 {_JSD.format(a='greatest(1e-12, least(1 - 1e-12, q))', b='p_a')} AS jsd,
 row_number() OVER (PARTITION BY utt, claimed ORDER BY round(llr, 9), ord) AS rank FROM k) WHERE rank <= 8""")
def llr_contributions(spark, sf):
    """Evidence per class for every probe and claimed speaker, worst first.

    Probes and models are one row each with their classes packed, so a claim is
    ranked inside its row and no class rows are shuffled.
    """
    enrol, probe = enrol_probe(spark, sf)
    cells = probe.groupBy("utt").agg(F.map_from_entries(F.collect_list(F.struct("cls", F.struct("n_a", "n_b")))).alias("cells"))  # at most 21 entries
    m = L.models(enrol).filter("not low").groupBy(F.col("speaker").alias("claimed")).agg(F.collect_list(F.struct("cls", "ord", "p_a", "l_a", "l_b")).alias("classes"))  # at most 21
    pairs = each_with_each(cells, m, enrol.select("speaker").distinct(), ["claimed"], ["utt"])

    def evidence(k, n):
        total, first, p = n["n_a"] + n["n_b"], n["n_a"] >= n["n_b"], k["p_a"]
        llr = n["n_a"] * k["l_a"] + n["n_b"] * k["l_b"]
        return F.when(total > 0, F.struct(
            F.round(llr, 9).alias("key"), k["ord"].alias("ord"), k["cls"].alias("cls"), total.alias("n"), llr.alias("llr"), F.when(p >= 1 - p, "A").otherwise("B").alias("expected"), F.greatest(p, 1 - p).alias("expected_p"),
            F.when(first, "A").otherwise("B").alias("observed"), F.when(first, p).otherwise(1 - p).alias("observed_p"), (n["n_a"] / total).alias("q"), p.alias("p")))

    # each class's counts are looked up once; the divergence is computed for the rows that stay
    every = F.transform("classes", lambda k: let(F.try_element_at("cells", k["cls"]), lambda n: evidence(k, n)))
    ranked = F.slice(F.sort_array(F.array_compact(every)), 1, 8)
    rows = compute_once(pairs, ["utt", "claimed"], ranked=ranked)
    return rows.select("utt", "claimed", F.posexplode("ranked").alias("_r", "e")).select("utt", "claimed", (F.col("_r") + 1).alias("rank"), "e.*").withColumn("jsd", jsd2(F.col("q"), F.col("p")))


def llr_split(spark, sf):
    """Trials with their part and cohort-normalised scores: statistics come from impostor trials of dev probes only."""
    t = llr_parts(spark, sf).transform(hold)
    return L.apply_znorm(t, L.cohort_stats(t.filter("probe_dev")))


@query("trial_split", "part is_genuine:b n:l n_claimed:l", f"WITH {Q.ZN} SELECT part, is_genuine, count(*) AS n, count(DISTINCT claimed) AS n_claimed FROM zt GROUP BY ALL")
def trial_split(spark, sf):
    return llr_parts(spark, sf).groupBy("part", "is_genuine").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("claimed").alias("n_claimed"))


@query("znorm", "utt:l claimed part z:d score:d", f"WITH {Q.ZN} SELECT * FROM zt")
def znorm(spark, sf):
    return llr_split(spark, sf)
