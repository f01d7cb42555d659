"""Event-series, keyed-state and fact queries over `events`, `customer` and `nation`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verilens.functions.text import slug
from verilens.functions.times import micros
from verilens.operators import corpus as H
from verilens.operators import series as R
from verilens.operators import state as ST
from verilens.operators.scan import exact_quantiles, running, time_bucket
from verilens.plans.registry import query
from verilens.sources import versioned, views
from verilens.sources.tables import small_side, table
from verilens.sources.held import hold

_NUM = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS len FROM events)"


def series(spark, sf):
    e = views.events(spark, sf).select("user_id", "event_id", "ts", "value")
    return R.numbered(e, ["user_id"], "ts", "event_id").transform(hold)


@query("zero_runs", "user_id:l start:l stop:l n:l", """WITH g AS (SELECT *, row_number() OVER w AS rn, sum((value >= 40)::INT) OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, min(rn) - 1 AS start, max(rn) AS stop, count(*) AS n FROM g WHERE value < 40 GROUP BY user_id, bad HAVING count(*) >= 3""")
def zero_runs(spark, sf):
    """Runs of at least three low readings, as [start, stop) positions."""
    e = views.events(spark, sf).select("user_id", "event_id", "ts", "value")
    return R.true_runs(e, ["user_id"], "ts", "event_id", F.col("value") < 40, 3).withColumnRenamed("end", "stop")


@query("curvature_spikes", "user_id:l rn:l curve:d", f"""WITH {_NUM}, c AS (SELECT user_id, rn, value, (rn - 1) // 20 AS blk, abs(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w) AS curve FROM e WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
 l AS (SELECT user_id, blk, quantile_cont(curve, 0.5) AS m, sqrt(avg(value * value)) AS r FROM c GROUP BY ALL), g AS (SELECT user_id, sqrt(avg(value * value)) AS g FROM events GROUP BY ALL),
 s AS (SELECT user_id, rn, curve FROM c JOIN l USING (user_id, blk) JOIN g USING (user_id) WHERE curve > greatest(3 * m, 0.5 * greatest(r, 0.1 * g)))
 SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.user_id = s.user_id AND p.rn = s.rn - 1)""")
def curvature_spikes(spark, sf):
    return R.curvature_spikes(series(spark, sf), "user_id", "value")


@query("series_quality", "user_id:l seconds:d rms:d peak:d clip_share:d silent:b too_short:b", """SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak,
 avg((value >= 200)::INT) AS clip_share, sqrt(avg(value * value)) < 1e-4 AS silent, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 < 86400 AS too_short FROM events GROUP BY ALL""")
def series_quality(spark, sf):
    x = F.col("value")
    return views.events(spark, sf).groupBy("user_id").agg(
        ((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6).alias("seconds"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"),
        F.avg((x >= 200).cast("int")).alias("clip_share")).withColumn("silent", F.col("rms") < 1e-4).withColumn("too_short", F.col("seconds") < 86400)


@query("series_snr", "user_id:l noise:d speech:d snr:d", f"""WITH {_NUM}, w AS (SELECT user_id, rn, len, sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) AS rms FROM e),
 f AS (SELECT user_id, min(rms) AS lo, quantile_cont(rms, 0.95) AS hi FROM w WHERE (rn - 1) % 2 = 0 AND rn - 1 + 12 < len GROUP BY ALL)
 SELECT user_id, 20 * log10(lo + 1e-12) AS noise, 20 * log10(hi + 1e-12) AS speech, 20 * log10(hi + 1e-12) - 20 * log10(lo + 1e-12) AS snr FROM f""")
def series_snr(spark, sf):
    """Loud percentile against the quietest sliding window, in dB."""
    w = R.sliding_rms(series(spark, sf), "user_id", "value", 12, 2).transform(hold)
    q = exact_quantiles(w, ["user_id"], "rms", {"lo": 0.0, "hi": 0.95})
    db = lambda c: 20 * F.log10(F.col(c) + 1e-12)
    return q.select("user_id", db("lo").alias("noise"), db("hi").alias("speech"), (db("hi") - db("lo")).alias("snr"))


_FR = "fr AS (SELECT user_id, epoch_us(ts) // 86400000000 AS frame, avg(value * value) AS ms, count(*) AS n FROM events GROUP BY ALL)"


@query("series_trim", "user_id:l first:l last:l frames:l", f"""WITH {_FR}, d AS (SELECT *, 20 * log10((sqrt(ms) + 1e-10) / (max(sqrt(ms) + 1e-10) OVER (PARTITION BY user_id))) AS db FROM fr)
 SELECT user_id, min(frame) FILTER (db > -12) - 1 AS first, max(frame) FILTER (db > -12) + 1 AS last, count(*) FILTER (db > -12) AS frames FROM d GROUP BY ALL""")
def series_trim(spark, sf):
    """First and last frame within 12 dB of the loudest, padded by one frame."""
    f = R.frames(views.events(spark, sf), "user_id", "ts", "value")
    top = f.groupBy("user_id").agg(F.max("ms").alias("top"))
    loud = 20 * F.log10((F.sqrt("ms") + 1e-10) / (F.sqrt("top") + 1e-10)) > -12
    return f.join(top, "user_id").groupBy("user_id").agg((F.min(F.when(loud, F.col("frame"))) - 1).alias("first"), (F.max(F.when(loud, F.col("frame"))) + 1).alias("last"), F.count_if(loud).alias("frames"))


@query("series_envelope", "user_id:l frame:l env:d", f"WITH {_FR} SELECT user_id, frame, ln(ms + 1e-10) - avg(ln(ms + 1e-10)) OVER (PARTITION BY user_id) AS env FROM fr")
def series_envelope(spark, sf):
    f = R.frames(views.events(spark, sf), "user_id", "ts", "value").withColumn("l", F.log(F.col("ms") + 1e-10))
    m = f.groupBy("user_id").agg(F.avg("l").alias("m"))
    return f.join(m, "user_id").select("user_id", "frame", (F.col("l") - F.col("m")).alias("env"))


_LE = f"""{_FR}, x AS (SELECT user_id, 10 * log10(ms + 1e-12) AS le, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS nf FROM fr),
 c AS (SELECT user_id, quantile_cont(le, 0.1) + 0.35 * greatest(quantile_cont(le, 0.9) - quantile_cont(le, 0.1), 1) AS cut FROM x GROUP BY ALL)"""


@query("level_steps", "user_id:l start:l stop:l before:d after:d step:d", f"""WITH {_LE}, q AS (SELECT x.*, le <= cut AS quiet, sum((le > cut)::INT) OVER (PARTITION BY user_id ORDER BY idx) AS bad FROM x JOIN c USING (user_id)),
 r AS (SELECT user_id, nf, min(idx) AS s, max(idx) + 1 AS e FROM q WHERE quiet GROUP BY user_id, nf, bad HAVING count(*) >= 2), k AS (SELECT *, greatest(1, (e - s) // 2) AS half FROM r WHERE s >= 2 AND e <= nf - 2),
 sd AS (SELECT user_id, s, e, 'l' AS side, greatest(0, s - 5) AS a, s + half AS b FROM k UNION ALL SELECT user_id, s, e, 'r', e - half, least(nf, e + 5) FROM k),
 v AS (SELECT sd.*, le, row_number() OVER (PARTITION BY sd.user_id, s, side ORDER BY le, idx) AS rk FROM sd JOIN x ON x.user_id = sd.user_id AND idx >= a AND idx < b),
 t AS (SELECT user_id, s, e, avg(le) FILTER (side = 'l') AS l, avg(le) FILTER (side = 'r') AS r FROM v WHERE rk <= greatest(1, floor((b - a) * 0.3)) GROUP BY ALL)
 SELECT user_id, s AS start, e AS stop, l AS before, r AS after, abs(l - r) AS step FROM t WHERE abs(l - r) >= 4""")
def level_steps(spark, sf):
    """Quiet stretches whose background level changes by at least 4 dB from one side to the other."""
    f = R.frames(views.events(spark, sf), "user_id", "ts", "value")
    w = Window.partitionBy("user_id")  # one row per day
    x = f.select("user_id", (10 * F.log10(F.col("ms") + 1e-12)).alias("le"), (F.row_number().over(w.orderBy("frame")) - 1).alias("idx"), F.count("*").over(w).alias("n_frames")).transform(hold)
    q = exact_quantiles(x, ["user_id"], "le", {"p10": 0.1, "p90": 0.9})
    cut = q.select("user_id", (F.col("p10") + 0.35 * F.greatest(F.col("p90") - F.col("p10"), F.lit(1.0))).alias("cut"))
    return R.level_steps(x, "user_id", cut, 2, 5, 4.0).select("user_id", F.col("s").alias("start"), F.col("e").alias("stop"), F.col("l").alias("before"), F.col("r").alias("after"), "step")


@query("gaps", "user_id:l event_id:l gap:d", """SELECT user_id, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events QUALIFY gap IS NOT NULL""")
def gaps(spark, sf):
    """Time to the next event of the series, from numbered rows in blocks that see one row ahead."""
    b = R.blocks(series(spark, sf), 512, after=1)
    w = Window.partitionBy("user_id", "blk").orderBy("rn")
    g = b.withColumn("gap", (micros(F.lead("ts").over(w)) - micros("ts")) / 1e6)
    return g.filter("own and gap is not null")


# ------------------------------------------------------------ keyed state

FIVE_DAYS, HALF_DAY = 432_000, 43_200
RULE = ST.Throttle(free=3, base=3600.0, maximum=43_200.0, forget=FIVE_DAYS)


def attempts(spark, sf):
    e = views.events(spark, sf).filter("event_type in ('error', 'purchase')")
    return e.select(F.col("user_id").alias("identity"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "error").alias("failed"))


_THR = """a AS (SELECT user_id AS identity, event_id AS id, epoch_us(ts) AS us, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'purchase')),
 ls AS (SELECT a.*, (SELECT max(us) FROM a s WHERE s.identity = a.identity AND NOT s.failed AND s.us < a.us) AS ok_us FROM a),
 lv AS (SELECT ls.identity, ls.id, any_value(ls.us) AS us, any_value(ls.failed) AS failed, count(f.us) AS n_live, max(f.us) AS last FROM ls LEFT JOIN a f ON f.identity = ls.identity AND f.failed AND f.us < ls.us AND f.us > ls.us - 432000000000
  AND (ok_us IS NULL OR f.us >= ok_us) GROUP BY ls.identity, ls.id),
 tw AS (SELECT *, CASE WHEN n_live > 3 THEN greatest(0, (last - us) / 1e6 + least(43200, 3600 * 2 ** (n_live - 4))) ELSE 0 END AS wait FROM lv)"""


@query("throttle_wait", "identity:l id:l failed:b n_live:l wait:d", f"WITH {_THR} SELECT * FROM tw")
def throttle_wait(spark, sf):
    return ST.throttle_waits(attempts(spark, sf), RULE)


@query("longest_wait", "wait:d blocked:l", f"WITH {_THR} SELECT max(wait) AS wait, count(DISTINCT identity) FILTER (wait > 0) AS blocked FROM tw")
def longest_wait(spark, sf):
    w = ST.throttle_waits(attempts(spark, sf), RULE)
    return w.agg(F.max("wait").alias("wait"), F.count_distinct(F.when(F.col("wait") > 0, F.col("identity"))).alias("blocked"))


def issued_answered(spark, sf):
    e = views.events(spark, sf)
    i = e.filter("event_type = 'view'").select(F.col("user_id").alias("identity"), F.col("event_id").alias("challenge"), F.col("ts").alias("issued"))
    a = e.filter("event_type = 'click'").select(F.col("user_id").alias("identity"), F.col("event_id").alias("answer"), F.col("ts").alias("answered"))
    return i, a


_CH = """i AS (SELECT user_id, event_id AS challenge, epoch_us(ts) AS us FROM events WHERE event_type = 'view'), a AS (SELECT user_id, event_id AS answer, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
 m AS (SELECT a.user_id, answer, a.us, arg_max(challenge, (i.us, challenge)) AS challenge FROM a JOIN i ON i.user_id = a.user_id AND a.us > i.us AND a.us - i.us <= 43200000000 GROUP BY ALL),
 f AS (SELECT user_id, challenge, arg_min(answer, (us, answer)) AS answer, min(us) AS us, count(*) - 1 AS replays FROM m GROUP BY ALL)"""


@query("challenge_consume", "identity:l challenge:l status answer:l latency:d replays:l", f"""WITH {_CH} SELECT i.user_id AS identity, i.challenge, CASE WHEN f.answer IS NULL THEN 'expired' ELSE 'consumed' END AS status, f.answer, (f.us - i.us) / 1e6 AS latency, coalesce(replays, 0) AS replays
 FROM i LEFT JOIN f ON f.user_id = i.user_id AND f.challenge = i.challenge""")
def challenge_consume(spark, sf):
    return ST.consume_challenges(*issued_answered(spark, sf), HALF_DAY)


@query("liveness_flag", "identity:l n:l live:l", f"WITH {_CH} SELECT i.user_id AS identity, count(*) AS n, count(*) FILTER (f.us - i.us <= 21600000000) AS live FROM i LEFT JOIN f ON f.user_id = i.user_id AND f.challenge = i.challenge GROUP BY ALL")
def liveness_flag(spark, sf):
    """Answered in time, by the tighter liveness limit."""
    c = ST.consume_challenges(*issued_answered(spark, sf), HALF_DAY)
    return c.groupBy("identity").agg(F.count("*").alias("n"), F.count_if(F.col("latency") <= HALF_DAY / 2).alias("live"))


@query("stepup_state", "user_id:l step_up:b since:l", "SELECT user_id, arg_max(event_type, (ts, event_id)) = 'signup' AS step_up, arg_max(event_id, (ts, event_id)) AS since FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY ALL")
def stepup_state(spark, sf):
    """The last decision of each identity: a borderline one leaves the step-up flag set, any other clears it."""
    e = views.events(spark, sf).filter("event_type in ('signup', 'purchase', 'error')").select("user_id", "event_type", "event_id", "ts")
    return H.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", (F.col("event_type") == "signup").alias("step_up"), F.col("event_id").alias("since"))


@query("span_filter", "user_id:l n:l restricted:b", """WITH s AS (SELECT user_id, min(epoch_us(ts)) FILTER (event_type = 'purchase') - 200000 AS a, max(epoch_us(ts)) FILTER (event_type = 'purchase') + 200000 AS b FROM events GROUP BY ALL)
 SELECT e.user_id, count(*) FILTER (coalesce(b - a, 0) <= 864000000000 OR epoch_us(ts) BETWEEN a AND b) AS n, coalesce(b - a, 0) > 864000000000 AS restricted FROM events e JOIN s USING (user_id) GROUP BY ALL""")
def span_filter(spark, sf):
    """Rows inside the matched span (padded), or all rows when the span is too short."""
    e = views.events(spark, sf)
    us = micros("ts")
    buy = F.when(F.col("event_type") == "purchase", us)
    s = e.groupBy("user_id").agg((F.min(buy) - 200_000).alias("a"), (F.max(buy) + 200_000).alias("b"))
    long = F.coalesce(F.col("b") - F.col("a"), F.lit(0)) > 864_000_000_000
    return e.join(s, "user_id").groupBy("user_id", long.alias("restricted")).agg(F.count_if(~long | us.between(F.col("a"), F.col("b"))).alias("n"))


# ------------------------------------------------------------ facts

PREDICATES = ("balance", "nation", "priority", "segment")


def facts(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").join(small_side(n), "c_nationkey", "left")
    return c.select(F.col("c_custkey").alias("speaker"), F.expr("stack(2, 'nation', n_name, 'segment', c_mktsegment) AS (predicate, value)"))


_FACTS = "facts AS (SELECT c_custkey AS speaker, 'nation' AS predicate, n_name AS value FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)"
_CHANGES = """ch AS (SELECT c_custkey AS speaker, 'nation' AS predicate, n_name AS value, DATE '1970-01-01' AS day, 0 AS seq, false AS removed FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT c_custkey, 'segment', c_mktsegment, DATE '1970-01-01', 0, false FROM customer UNION ALL SELECT c_custkey, 'balance', CASE WHEN c_acctbal >= 0 THEN c_acctbal::BIGINT::VARCHAR END, DATE '1970-01-01', 0, false FROM customer
 UNION ALL SELECT o_custkey, 'priority', o_orderpriority, o_orderdate::DATE, o_orderkey, o_orderstatus = 'P' FROM orders),
 st AS (SELECT speaker, predicate, arg_max({'v': value, 'r': removed}, (day, seq)) AS m FROM ch GROUP BY ALL), now AS (SELECT speaker, predicate, m.v AS value FROM st WHERE NOT m.r)"""


def fact_changes(spark, sf):
    """The log of changes to facts: what is known of a customer from the start, and each order's priority, which an open order takes away again."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").join(small_side(n), "c_nationkey", "left").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.bround("c_acctbal").cast("long").cast("string")))
    first = c.select(F.col("c_custkey").alias("speaker"), F.expr("stack(3, 'nation', n_name, 'segment', c_mktsegment, 'balance', balance) AS (predicate, value)"), F.lit("1970-01-01").cast("date").alias("at"),
                     F.lit(0).cast("long").alias("seq"), F.lit(False).alias("removed"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("speaker"), F.lit("priority").alias("predicate"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").cast("date").alias("at"),
                                          F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "P").alias("removed"))
    return first.unionByName(o)


@query("fact_state", "speaker:l predicate value", f"WITH {_CHANGES} SELECT * FROM now")
def fact_state(spark, sf):
    """Facts after all upserts and removals."""
    return versioned.state(fact_changes(spark, sf), ["speaker", "predicate"], ["at", "seq"])


@query("fact_completeness", "speaker:l n:l completeness:d missing", f"""WITH {_CHANGES}, p AS (SELECT c_custkey AS speaker, unnest(['balance', 'nation', 'priority', 'segment']) AS predicate FROM customer)
 SELECT p.speaker, count(value) AS n, count(value) / 4.0 AS completeness, coalesce(string_agg(p.predicate, ',' ORDER BY p.predicate) FILTER (value IS NULL), '') AS missing FROM p LEFT JOIN now USING (speaker, predicate) GROUP BY p.speaker""")
def fact_completeness(spark, sf):
    """Share of the predicates that each customer has a value for, and those that are missing."""
    known = fact_state(spark, sf)
    have = known.filter("value is not null").groupBy("speaker").agg(F.collect_set("predicate").alias("p"))  # at most one entry per predicate
    every = F.array(*[F.lit(p) for p in PREDICATES])
    p = F.coalesce("p", F.array().cast("array<string>"))
    all_of = table(spark, sf, "customer").select(F.col("c_custkey").alias("speaker")).join(have, "speaker", "left")
    return all_of.select("speaker", F.size(p).alias("n"), (F.size(p) / len(PREDICATES)).alias("completeness"), F.concat_ws(",", F.array_sort(F.array_except(every, p))).alias("missing"))


@query("facts_by_class", "speaker:l predicate label", f"WITH {_FACTS} SELECT speaker, predicate, value AS label FROM facts WHERE predicate = 'segment' AND value IN ('HOUSEHOLD', 'MACHINERY')")
def facts_by_class(spark, sf):
    return facts(spark, sf).filter("predicate = 'segment' and value in ('HOUSEHOLD', 'MACHINERY')").withColumnRenamed("value", "label")


@query("triples", "s p o", f"""WITH {_FACTS}, t AS (SELECT 'speaker/' || speaker AS sp, 'fact/' || speaker || '/' || predicate AS f, predicate, value FROM facts)
 SELECT sp AS s, 'has' AS p, f AS o FROM t UNION ALL SELECT f, 'type', predicate FROM t UNION ALL SELECT f, 'value', coalesce(nullif(trim(regexp_replace(value, '\\W+', '_', 'g'), '_'), ''), 'unknown') FROM t UNION ALL SELECT f, 'label', value FROM t""")
def triples(spark, sf):
    f = F.concat_ws("/", F.lit("fact"), F.col("speaker").cast("string"), "predicate")
    rows = [(F.concat(F.lit("speaker/"), "speaker"), "has", f), (f, "type", F.col("predicate")), (f, "value", slug(F.col("value"))), (f, "label", F.col("value"))]
    return facts(spark, sf).select(F.inline(F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in rows])))


@query("slug", "c_custkey:l slug", "SELECT c_custkey, coalesce(nullif(trim(regexp_replace(trim(c_name), '\\W+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM customer")
def slug_query(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", slug(F.col("c_name")).alias("slug"))


@query("facts_anonymised", "speaker:l n:l predicates completeness:d", f"WITH {_FACTS} SELECT speaker, count(*) AS n, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates, count(DISTINCT predicate) / 4.0 AS completeness FROM facts GROUP BY ALL")
def facts_anonymised(spark, sf):
    return facts(spark, sf).groupBy("speaker").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("predicate"))).alias("predicates"), (F.count_distinct("predicate") / len(PREDICATES)).alias("completeness"))


@query("facts_from_triples", "speaker:l predicate value", """SELECT o_custkey AS speaker, trim(o_orderpriority) AS predicate, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value FROM orders WHERE trim(o_orderpriority) <> '' AND trim(o_orderstatus) <> '' GROUP BY ALL""")
def facts_from_triples(spark, sf):
    """Trimmed triples with empty parts dropped; the last value of a predicate wins."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("speaker"), F.trim("o_orderpriority").alias("predicate"), F.trim("o_orderstatus").alias("value"), "o_orderdate", "o_orderkey")
    return H.latest(t.filter("predicate <> '' and value <> ''"), ["speaker", "predicate"], ["o_orderdate", "o_orderkey"])
