"""SQL text of the views, for the DuckDB checks. Mirrors ``verilens.sources.views``."""

from __future__ import annotations

from verilens.functions.text import TOKEN_PATTERN

PAT = TOKEN_PATTERN.replace("'", "''")

UTT = """utt AS (SELECT doc_id AS utt, source AS speaker, (doc_id // 20) % 4 AS session, doc_id % 5 AS prompt,
 lang AS doc_lang, text, n_chars FROM documents)"""

TOK = UTT + f""",
tok0 AS (SELECT utt, speaker, session, prompt, doc_lang, unnest(regexp_extract_all(text, '{PAT}')) AS text,
  generate_subscripts(regexp_extract_all(text, '{PAT}'), 1) AS pos FROM utt),
tok AS (SELECT *, CASE WHEN regexp_matches(text, '^[aeiouAEIOU]') THEN 'A' WHEN regexp_matches(text, '^\\p{{L}}') THEN 'B'
  ELSE 'NEUTRAL' END AS lang, 'C' || least(length(text), 21) AS cls, (least(length(text), 21) - 1) // 4 AS sup,
  length(text) >= 19 AS low, 1 - (pos % 10) / 20.0::DOUBLE AS conf FROM tok0)"""

# Choice tokens with the previous choice label inside the utterance.
CHOICE = TOK + """,
ch AS (SELECT *, lag(lang) OVER (PARTITION BY utt ORDER BY pos) AS prev FROM tok WHERE lang IN ('A', 'B'))"""

CLS = """dim_cls AS (SELECT 'C' || i AS cls, i AS ord, (i - 1) // 4 AS sup, i >= 19 AS low, i <= 13 AS elicitable
  FROM range(1, 22) t(i))"""

VEC = """vec AS (SELECT vec_id, label::BIGINT AS speaker, vec_id % 3 AS session, embedding::DOUBLE[] AS raw FROM embeddings),
uv AS (SELECT vec_id, speaker, session, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS v FROM vec),
dims AS (SELECT vec_id, speaker, session, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM uv)"""


def unit(e: str) -> str:
    return f"list_transform({e}, lambda x: x / sqrt(list_dot_product({e}, {e})))"


# Template of each speaker without one session.
HOLD = VEC + f""",
folds AS (SELECT DISTINCT speaker, session AS fold FROM uv),
rest AS (SELECT f.speaker AS claimed, f.fold, list(x ORDER BY d) AS c FROM
  (SELECT f.speaker, f.fold, d, avg(x) AS x FROM folds f JOIN dims ON dims.speaker = f.speaker AND dims.session <> f.fold
   GROUP BY ALL) f GROUP BY ALL),
tmpl AS (SELECT claimed, fold, {unit('c')} AS c FROM rest)"""

TRIALS = HOLD + """,
trials AS (SELECT vec_id, speaker AS probe_speaker, session, claimed, fold, speaker = claimed AS is_genuine,
  list_dot_product(v, c) AS score FROM uv JOIN tmpl ON speaker <> claimed OR session = fold)"""

CENT = VEC + f""",
cent AS (SELECT speaker AS claimed, {unit('c')} AS c FROM (SELECT speaker, list(x ORDER BY d) AS c FROM
  (SELECT speaker, d, avg(x) AS x FROM dims GROUP BY ALL) GROUP BY ALL)),
ctrials AS (SELECT vec_id, speaker AS probe_speaker, session, claimed, speaker = claimed AS is_genuine,
  list_dot_product(v, c) AS score FROM uv CROSS JOIN cent)"""

ATT = """att AS (SELECT l_orderkey AS item, l_linenumber::BIGINT AS attack, l_suppkey AS speaker, l_discount * 10 AS s_voice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_tax / 0.08::DOUBLE END AS s_graph, l_quantity / 50 AS s_know,
  l_discount >= 0.02::DOUBLE AS admissible, l_orderkey % 5 = 0 AS simulated, l_returnflag <> 'R' AS liveness_ok,
  CASE WHEN l_partkey % 4 <> 0 THEN (l_partkey % 100) / 100.0::DOUBLE END AS integrity,
  l_linestatus AS status, l_returnflag AS flag, l_shipdate AS at FROM lineitem)"""


def curve(trials: str, groups: str, name: str = "cv") -> str:
    """CTEs: exact FAR/FRR curve of ``trials`` grouped by ``groups``, by plain windows."""
    g = groups
    on = " AND ".join(f"o.{c.strip()} = n.{c.strip()}" for c in g.split(","))
    return f"""{name}_n AS (SELECT {g}, count(*) FILTER (is_genuine) AS g, count(*) FILTER (NOT is_genuine) AS i,
  count(*) FILTER (is_genuine AND score = '-inf') AS vg, count(*) FILTER (NOT is_genuine AND score = '-inf') AS vi,
  min(score) FILTER (score > '-inf') AS lowest FROM {trials} WHERE score IS NOT NULL GROUP BY ALL),
{name}_h AS (SELECT {g}, score AS t, count(*) FILTER (is_genuine) AS n_gen, count(*) FILTER (NOT is_genuine) AS n_imp
  FROM {trials} WHERE score > '-inf' GROUP BY ALL),
{name}_o AS (SELECT *, coalesce(sum(n_gen) OVER w, 0) AS bg, coalesce(sum(n_imp) OVER w, 0) AS bi FROM {name}_h
  WINDOW w AS (PARTITION BY {g} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT {", ".join("o." + c.strip() for c in g.split(","))}, o.t, o.n_gen, o.n_imp, n.g, n.i, n.vg + bg AS below_gen,
  n.vi + bi AS below_imp, true AS observed, (n.i - n.vi - bi) / n.i::DOUBLE AS far, (n.vg + bg) / n.g::DOUBLE AS frr
  FROM {name}_o o JOIN {name}_n n ON {on} WHERE n.g > 0 AND n.i > 0
  UNION ALL SELECT {g}, lowest - 1, 0, 0, g, i, vg, vi, false, (i - vi) / i::DOUBLE, vg / g::DOUBLE FROM {name}_n
  WHERE lowest IS NOT NULL AND g > 0 AND i > 0)"""


def metrics(groups: str, name: str = "cv", out: str = "mt") -> str:
    """CTEs: metrics per group off the curve ``name``; EER by the first sign change of FAR - FRR in threshold order."""
    g = groups
    return f"""{out}_s AS (SELECT *, far - frr AS dd, lead(far - frr) OVER w AS d1, lead(far) OVER w AS far1, lead(frr) OVER w AS frr1,
  lead(t) OVER w AS t1, row_number() OVER w AS ix FROM {name} WINDOW w AS (PARTITION BY {g} ORDER BY t)),
{out}_c AS (SELECT {g}, min(ix) AS ix FROM {out}_s WHERE d1 IS NOT NULL AND sign(dd) <> sign(d1) GROUP BY ALL),
{out}_x AS (SELECT {g}, greatest(0, least(1, far + a * (far1 - far))) AS eer, t + a * (t1 - t) AS eer_t FROM
  (SELECT s.*, CASE WHEN d1 = dd THEN 0 ELSE -dd / (d1 - dd) END AS a FROM {out}_s s SEMI JOIN {out}_c c USING ({g}, ix))),
{out}_a AS (SELECT {g}, max(g) AS n_gen, max(i) AS n_imp, min(below_gen) AS veto_gen, min(below_imp) AS veto_imp,
  arg_min((far + frr) / 2, (abs(dd), t)) AS near, arg_min(t, (abs(dd), t)) AS near_t,
  arg_min((far + frr) / 2, (abs(dd), t)) FILTER (observed) AS eer_nearest, arg_min(t, (abs(dd), t)) FILTER (observed) AS eer_nearest_t,
  min((0.05::DOUBLE * frr + 0.95::DOUBLE * far) / 0.05::DOUBLE) AS min_dcf,
  min(far) FILTER (frr <= 0.01) AS far_at_frr_1pct, min(frr) FILTER (far <= 0.01) AS frr_at_far_1pct,
  sum(n_gen::DOUBLE * (below_imp + n_imp / 2.0::DOUBLE)) AS u, min(t) FILTER (observed AND n_gen > 0) AS gen_min,
  max(t) FILTER (observed AND n_imp > 0) AS imp_max, count(*) AS n_points FROM {out}_s GROUP BY ALL),
{out} AS (SELECT a.*, coalesce(x.eer, near) AS eer, coalesce(x.eer_t, near_t) AS eer_t,
  (u + veto_gen * veto_imp / 2.0::DOUBLE) / (n_gen * n_imp) AS auc,
  CASE WHEN gen_min > imp_max THEN (gen_min + imp_max) / 2 ELSE coalesce(x.eer_t, near_t) END AS thr_eer
  FROM {out}_a a LEFT JOIN {out}_x x USING ({g}))"""


COUNTS = ["n_a", "n_b", "t_aa", "t_ab", "t_ba", "t_bb"]


def cells(src: str, key: str, name: str) -> str:
    """CTE: six counts per (key, class) from choice tokens ``src``."""
    return f"""{name} AS (SELECT {key}, cls, count(*) FILTER (lang = 'A') AS n_a, count(*) FILTER (lang = 'B') AS n_b,
  count(*) FILTER (prev = 'A' AND lang = 'A') AS t_aa, count(*) FILTER (prev = 'A' AND lang = 'B') AS t_ab,
  count(*) FILTER (prev = 'B' AND lang = 'A') AS t_ba, count(*) FILTER (prev = 'B' AND lang = 'B') AS t_bb
  FROM {src} GROUP BY ALL)"""


def dense(src: str, key: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, cls, ord, sup, low, elicitable, {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)}
  FROM (SELECT DISTINCT {key} FROM {src}) CROSS JOIN dim_cls LEFT JOIN {src} USING ({key}, cls))"""


def smooth(src: str, key: str, name: str) -> str:
    """CTEs: the smoothed graph of dense counts ``src``."""
    return f"""{name}_0 AS (SELECT *, (sum(n_a) OVER w + 1.0::DOUBLE) / (sum(n_a + n_b) OVER w + 2.0::DOUBLE) AS marginal,
  sum(n_a) OVER g AS ga, sum(n_a + n_b) OVER g AS gn FROM {src}
  WINDOW w AS (PARTITION BY {key}), g AS (PARTITION BY {key}, sup)),
{name}_1 AS (SELECT *, (n_a + 4 * ((ga + 8 * marginal) / (gn + 8.0::DOUBLE))) / (n_a + n_b + 4.0::DOUBLE) AS p_a FROM {name}_0),
{name} AS (SELECT *, (t_aa + 6 * p_a) / (t_aa + t_ab + 6.0::DOUBLE) AS pt_a, (t_ba + 6 * p_a) / (t_ba + t_bb + 6.0::DOUBLE) AS pt_b FROM {name}_1)"""


def loo(src: str, key: str, name: str, outer: str = "") -> str:
    p = f"PARTITION BY {outer + ', ' if outer else ''}cls"
    return f"""{name} AS (SELECT * FROM (SELECT {outer + ', ' if outer else ''}{key}, cls, ord, sup, low, elicitable,
  {", ".join(f"sum({c}) OVER w - {c} AS {c}" for c in COUNTS)}, count(*) OVER w AS speakers FROM {src} WINDOW w AS ({p})) WHERE speakers >= 3)"""


def mixing(src: str, utts: str, key: str, name: str) -> str:
    """CTEs: code-mixing metrics of choice tokens ``src`` (with prev), every key of ``utts`` kept."""
    return f"""{name}_r AS (SELECT {key}, utt, pos, lang, sum(CASE WHEN prev IS NULL OR prev <> lang THEN 1 ELSE 0 END)
  OVER (PARTITION BY utt ORDER BY pos) AS run FROM {src}),
{name}_l AS (SELECT {key}, utt, run, count(*) AS len FROM {name}_r GROUP BY ALL),
{name}_b AS (SELECT {key}, count(*) AS n_runs, avg(len) AS m, stddev_pop(len) AS s FROM {name}_l GROUP BY ALL),
{name}_c AS (SELECT {key}, count(*) AS n_choice, count(*) FILTER (lang = 'A') AS n_first, count(*) FILTER (prev <> lang) AS n_switches,
  count(prev) AS n_bounds FROM {src} GROUP BY ALL),
{name} AS (SELECT u.{key}, coalesce(n_choice, 0) AS n_choice, coalesce(n_first, 0) AS n_first, coalesce(n_switches, 0) AS n_switches,
  coalesce(n_bounds, 0) AS n_bounds, coalesce(n_runs, 0) AS n_runs,
  CASE WHEN n_choice > 0 THEN 100 * (1 - greatest(n_first, n_choice - n_first) / n_choice::DOUBLE) ELSE 0 END AS cmi,
  CASE WHEN n_first > 0 AND n_first < n_choice THEN 1 / ((n_first / n_choice::DOUBLE) ** 2 + (1 - n_first / n_choice::DOUBLE) ** 2) - 1 ELSE 0 END AS m_index,
  CASE WHEN n_bounds > 0 THEN n_switches / n_bounds::DOUBLE ELSE 0 END AS i_index,
  CASE WHEN n_runs >= 2 THEN (s / m - 1) / (s / m + 1) ELSE 0 END AS burstiness,
  CASE WHEN n_choice > 0 THEN n_first / n_choice::DOUBLE ELSE 0 END AS first_share
  FROM (SELECT DISTINCT {key} FROM {utts}) u LEFT JOIN {name}_c c ON c.{key} = u.{key} LEFT JOIN {name}_b b ON b.{key} = u.{key})"""


GRAPH = CHOICE + ", " + CLS + ", " + cells("ch", "speaker", "cl") + ", " + dense("cl", "speaker", "dn") + ", " + smooth("dn", "speaker", "gr")

_LN = "ln(greatest({a}, 1e-12)) - ln(greatest({b}, 1e-12))"


def ratios(own: str, rest: str, key: str, name: str) -> str:
    def two(c, x, y):
        return f"{_LN.format(a='o.' + c, b='r.' + c)} AS {x}, {_LN.format(a='1 - o.' + c, b='1 - r.' + c)} AS {y}"

    on = " AND ".join(f"o.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    return f"""{name} AS (SELECT {", ".join("o." + k.strip() for k in key.split(","))}, o.cls, o.ord, o.low, o.p_a,
  {two('p_a', 'l_a', 'l_b')}, {two('pt_a', 'l_aa', 'l_ab')}, {two('pt_b', 'l_ba', 'l_bb')}
  FROM {own} o JOIN {rest} r ON {on} AND o.cls = r.cls)"""


# Sessions 0-2 enrol, session 3 probes.
SPEECH = CHOICE + ", " + CLS + """,
en AS (SELECT * FROM ch WHERE session < 3), pr AS (SELECT * FROM ch WHERE session = 3),
""" + cells("en", "speaker", "ecl") + ", " + dense("ecl", "speaker", "edn") + ", " + smooth("edn", "speaker", "eg") + ", " \
    + loo("edn", "speaker", "eloo") + ", " + smooth("eloo", "speaker", "ebg") + ", " + ratios("eg", "ebg", "speaker", "mo") + ", " \
    + cells("pr", "utt, speaker", "pcl") + ", " \
    + mixing("en", "(SELECT speaker FROM utt WHERE session < 3)", "speaker", "emx") + ", " \
    + mixing("pr", "(SELECT utt FROM utt WHERE session = 3)", "utt", "pmx")


def streams(name: str = "st", low: bool = False) -> str:
    use = "true" if low else "NOT low"
    return f"""{name}_u AS (SELECT u.utt, u.speaker AS probe_speaker, c.speaker AS claimed FROM utt u CROSS JOIN (SELECT DISTINCT speaker FROM mo) c WHERE session = 3),
{name}_s AS (SELECT p.utt, m.speaker AS claimed, sum(CASE WHEN {use} THEN n_a * l_a + n_b * l_b ELSE 0 END) AS lx,
  sum(CASE WHEN {use} THEN n_a + n_b ELSE 0 END) AS nl, sum(CASE WHEN {use} THEN t_aa * l_aa + t_ab * l_ab + t_ba * l_ba + t_bb * l_bb ELSE 0 END) AS tx,
  sum(CASE WHEN {use} THEN t_aa + t_ab + t_ba + t_bb ELSE 0 END) AS nt FROM pcl p JOIN mo m USING (cls) GROUP BY ALL),
{name}_1 AS (SELECT u.utt, probe_speaker, u.claimed, probe_speaker = u.claimed AS is_genuine, coalesce(nl, 0) AS n_scored,
  CASE WHEN nl > 0 THEN lx / nl ELSE 0 END AS lex, CASE WHEN nt > 0 THEN tx / nt ELSE 0 END AS trans,
  greatest(0, least(1, (coalesce(nl, 0) - 20) / 40.0::DOUBLE)) AS confidence,
  (abs(p.cmi - e.cmi) / 100 + abs(p.i_index - e.i_index)) / 2 AS dist
  FROM {name}_u u LEFT JOIN {name}_s s ON s.utt = u.utt AND s.claimed = u.claimed JOIN pmx p ON p.utt = u.utt JOIN emx e ON e.speaker = u.claimed),
{name} AS (SELECT *, CASE WHEN confidence > 0 THEN -25 * dist ELSE 0 END AS met FROM {name}_1)"""


def mixed(src: str = "st", name: str = "lt", lexical: float = 0.6, transition: float = 0.3, met: float = 0.1) -> str:
    both = lexical + transition
    return f"""{name} AS (SELECT *, CASE WHEN n_scored >= 5 THEN 1 / (1 + exp(-raw / 2)) END AS score FROM
  (SELECT *, ({lexical / both!r} * lex + {transition / both!r} * trans) * (1 - {met!r} * confidence) + {met!r} * confidence * met AS raw FROM {src}))"""


def parts(src: str, a: str, b: str, name: str = "sp", share: float = 0.4) -> str:
    """CTEs: dev speakers by seeded digest rank, and the part of each trial."""
    return f"""{name}_k AS (SELECT DISTINCT k FROM (SELECT {a} AS k FROM {src} UNION ALL SELECT {b} FROM {src})),
{name}_d AS (SELECT k, row_number() OVER (ORDER BY md5('0|' || k), k) <= least(greatest(2, round_even(n * {share}::DOUBLE, 0)), n - 2) AS dev
  FROM {name}_k, (SELECT count(*) AS n FROM {name}_k) WHERE n >= 4),
{name} AS (SELECT t.*, CASE WHEN x.dev AND y.dev THEN 'dev' WHEN NOT x.dev AND NOT y.dev THEN 'test' ELSE 'cohort' END AS part,
  x.dev AS probe_dev FROM {src} t JOIN {name}_d x ON x.k = t.{a} JOIN {name}_d y ON y.k = t.{b})"""


LLR = SPEECH + ", " + streams() + ", " + mixed()
ZN = LLR + ", " + parts("lt", "probe_speaker", "claimed") + """,
zs AS (SELECT claimed, CASE WHEN count(*) < 2 THEN 0 ELSE avg(raw) END AS mean,
  CASE WHEN count(*) >= 2 AND stddev_samp(raw) > 1e-6 THEN stddev_samp(raw) ELSE 1 END AS std FROM sp WHERE NOT is_genuine AND probe_dev GROUP BY ALL),
zt AS (SELECT sp.* REPLACE (CASE WHEN score IS NOT NULL THEN 1 / (1 + exp(-((raw - coalesce(mean, 0)) / coalesce(std, 1)) / 1.5::DOUBLE)) END AS score),
  (raw - coalesce(mean, 0)) / coalesce(std, 1) AS z FROM sp LEFT JOIN zs USING (claimed))"""

TS = """ts AS (SELECT l_orderkey AS item, l_linenumber::BIGINT AS line, l_suppkey AS probe_speaker,
  CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE l_suppkey + 1 + l_partkey % 7 END AS claimed, l_linestatus = 'F' AS is_genuine,
  l_discount * 6 + CASE WHEN l_linestatus = 'F' THEN 0.35::DOUBLE ELSE 0 END AS s_voice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_tax / 0.08::DOUBLE * 0.6::DOUBLE + CASE WHEN l_linestatus = 'F' THEN 0.25::DOUBLE ELSE 0 END END AS s_graph,
  CASE WHEN l_partkey % 11 <> 0 THEN l_quantity / 100 + CASE WHEN l_linestatus = 'F' THEN 0.4::DOUBLE ELSE 0 END END AS s_know,
  l_returnflag AS device, l_suppkey % 4 AS region, l_shipdate AS at FROM lineitem)"""


def configs(table: dict, veto, name: str = "cfg") -> str:
    rows = []
    for i, (k, w) in enumerate(table.items()):
        v = veto.get(k) if isinstance(veto, dict) else veto
        rows.append(f"('{k}', {i}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE, {'NULL' if v is None else repr(v)}::DOUBLE)")
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) v(config, ord, w_voice, w_graph, w_know, veto))"


_ON = {b: f"CASE WHEN s_{b} IS NOT NULL THEN w_{b} ELSE 0 END" for b in ("voice", "graph", "know")}
_NUM = " + ".join(f"{on} * coalesce(s_{b}, 0)" for b, on in _ON.items())
_DEN = " + ".join(_ON.values())


def fused(src: str, cfg: str = "cfg", name: str = "fu") -> str:
    return f"""{name}_0 AS (SELECT *, CASE WHEN {_DEN} > 0 THEN ({_NUM}) / ({_DEN}) END AS mean,
  coalesce(w_graph > 0 AND s_graph < veto, false) AS vetoed FROM {src} CROSS JOIN {cfg}),
{name} AS (SELECT *, CASE WHEN vetoed OR mean IS NULL THEN '-inf'::DOUBLE ELSE mean END AS score FROM {name}_0)"""


def decided(src: str, name: str = "de", phrase: bool = False) -> str:
    """CTE: plain gates and weighted decision (no voice gate) over rows with fused parts."""
    ph = "WHEN phrase < 0.6 THEN 'phrase'" if phrase else ""
    return f"""{name} AS (SELECT *, CASE WHEN reason = 'reached' THEN 'ACCEPT' WHEN reason = 'near' THEN 'BORDERLINE' ELSE 'REJECT' END AS decision,
  CASE WHEN reason IN ('liveness', 'integrity', 'phrase', 'unmeasured') THEN 0 ELSE mean END AS fused FROM
  (SELECT *, CASE WHEN NOT liveness_ok THEN 'liveness' WHEN integrity < 0.25 THEN 'integrity' {ph} WHEN mean IS NULL THEN 'unmeasured'
   WHEN vetoed THEN 'veto' WHEN abs(mean - 0.55) <= 0.05 THEN 'near' WHEN mean >= 0.55 THEN 'reached' ELSE 'below' END AS reason FROM {src}))"""


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / {n}::DOUBLE)"
    mid = f"({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, {mid} - {half}) END", f"CASE WHEN {n} = 0 THEN 1 ELSE least(1, {mid} + {half}) END"
