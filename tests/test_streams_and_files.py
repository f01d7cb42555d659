"""Streams agree with batch; files round trip."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from verilens.operators.fusion import Policy, configs, decide
from verilens.operators.state import Throttle, consume_challenges, throttle_waits
from verilens.plans.decisions import FULL_W
from verilens.plans.series import attempts, issued_answered
from verilens.functions.times import micros
from verilens.session import checkpoint_root
from verilens.sources import files, views
from verilens.streaming import state

SF = "/root/testdata/sf0.001"


def replay(spark, df, tmp, name, order="ts", pieces=3):
    """Write a frame as time-ordered files and read them back as a stream, one file per micro-batch."""
    path = str(tmp / name)
    cuts = df.selectExpr(f"percentile_approx(unix_micros(cast({order} as timestamp)), array(0.33, 0.66)) as p").first().p
    us = micros(order)
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 2**62])):
        df.filter((us > lo) & (us <= hi)).withColumn(order, F.col(order).cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, tmp, name, mode="append"):
    root = checkpoint_root(spark, str(tmp))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/ck_{name}_{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def shuffled(spark, df, tmp, name, pieces=4, seed=3):
    """Write a frame in random pieces, so that rows arrive in any order, and read them as a stream, one piece a micro-batch."""
    path = str(tmp / name)
    for i in range(pieces):
        df.filter(F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(pieces)) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def then(spark, path, last):
    """One more file with rows after all others, which pass the watermark; read as a stream in the order of writing."""
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_throttle_stream_equals_batch_with_late_and_tied_rows(spark, tmp_path):
    state.use_state_store(spark)
    rule = Throttle(3, 3600.0, 43200.0, 432000)
    a = attempts(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    tied = a.filter("id % 5 = 0").withColumn("id", F.col("id") + 10**6)  # a second attempt at the same instant
    a = a.unionByName(tied).withColumn("us", F.expr("unix_micros(ts)"))
    want = {r.id: (r.n_live, round(r.wait, 3)) for r in throttle_waits(a.drop("us"), rule).collect()}
    end = a.agg(F.max("ts")).first()[0]
    last = a.limit(1).select(F.lit(-1).cast("long").alias("identity"), F.lit(-1).cast("long").alias("id"), (F.lit(end) + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(False).alias("failed"))
    last = last.withColumn("us", F.expr("unix_micros(ts)"))
    s = then(spark, shuffled(spark, a, tmp_path, "attempts"), last.select(*a.columns))
    got = {r.id: (r.n_live, round(r.wait, 3)) for r in drain(spark, state.throttle(s, rule, "365 days"), tmp_path, "throttled").filter("id >= 0").collect()}
    assert got == want and len(want) > 100


def test_challenges_are_consumed_once_and_expire(spark, tmp_path):
    state.use_state_store(spark)
    i, a = issued_answered(spark, SF)
    i, a = i.withColumn("issued", F.col("issued").cast("timestamp")), a.withColumn("answered", F.col("answered").cast("timestamp"))
    again = a.filter("answer % 3 = 0").select("identity", (F.col("answer") + 10**6).alias("answer"), (F.col("answered") + F.expr("INTERVAL 1 SECOND")).alias("answered"))
    a = a.unionByName(again)
    want = {r.challenge: (r.status, r.answer, r.latency and round(r.latency, 6), r.replays) for r in consume_challenges(i, a, 43200).collect()}
    end = i.agg(F.max("issued")).first()[0]
    far = F.lit(end) + F.expr("INTERVAL 400 DAYS")
    s_i = then(spark, shuffled(spark, i, tmp_path, "issued"), i.limit(1).select(F.lit(-1).cast("long").alias("identity"), F.lit(-1).cast("long").alias("challenge"), far.alias("issued")))
    s_a = then(spark, shuffled(spark, a, tmp_path, "answered"), a.limit(1).select(F.lit(-1).cast("long").alias("identity"), F.lit(-1).cast("long").alias("answer"), far.alias("answered")))
    rows = drain(spark, state.challenges(s_i, s_a, 43200, "365 days"), tmp_path, "challenges").filter("challenge >= 0").collect()
    got = {r.challenge: (r.status, r.answer, r.latency and round(r.latency, 6), r.replays) for r in rows}
    assert len(rows) == len(got) == len(want) and got == want
    assert {r.status for r in rows} == {"consumed", "expired"} and any(r.replays for r in rows)
    taken = [r.answer for r in rows if r.answer is not None]
    assert len(taken) == len(set(taken))


def test_duplicate_stream_keeps_first_of_each_digest(spark, tmp_path):
    e = views.events(spark, SF).select("event_id", "ts", F.md5(F.concat("user_id", "event_type")).alias("digest"))
    got = drain(spark, state.first_seen(replay(spark, e, tmp_path, "subs"), window="60 days"), tmp_path, "firsts")
    assert got.count() == e.select("digest").distinct().count() == got.select("digest").distinct().count()


def test_step_up_stream_keeps_the_last_decision_and_forgets(spark, tmp_path):
    state.use_state_store(spark)
    e = views.events(spark, SF).select(F.col("user_id").alias("identity"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "BORDERLINE").otherwise("ACCEPT").alias("decision"))
    path = shuffled(spark, e, tmp_path, "decisions")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    changes = drain(spark, state.step_up(s, 10**9, "365 days"), tmp_path, "flags", "update").collect()
    want = {r.identity: (r.d.decision == "BORDERLINE", r.d.id) for r in e.groupBy("identity").agg(F.max_by(F.struct("decision", "id"), F.struct("ts", "id")).alias("d")).collect()}
    when = {r.id: r.ts for r in e.collect()}
    last = {}
    for r in sorted(changes, key=lambda r: (when[r.since], r.since)):
        last[r.identity] = (r.step_up, r.since)
    assert last == want
    end = e.agg(F.max("ts")).first()[0]
    flush = e.limit(1).select(F.lit(-1).cast("long").alias("identity"), F.lit(10**7).cast("long").alias("id"), (F.lit(end) + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("ACCEPT").alias("decision"))
    s = then(spark, path, flush)
    after = drain(spark, state.step_up(s, 60, "365 days"), tmp_path, "forgotten", "update").filter("identity >= 0").collect()
    borderline = {i for i, (up, _) in want.items() if up}
    assert borderline <= {r.identity for r in after if not r.step_up}


def test_score_stream_equals_batch(spark, tmp_path):
    t = views.attack_trials(spark, SF)
    settings = t.select("speaker").distinct().select("speaker", F.inline(configs(FULL_W, 0.35)))
    cols = ["item", "attack", "speaker", "decision", "fused"]
    got = drain(spark, state.score(replay(spark, t, tmp_path, "probes", "at"), settings, Policy()), tmp_path, "scored").select(*cols)
    want = decide(t.join(settings, "speaker"), Policy()).select(*cols)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_manifest_round_trip_keeps_null_apart_from_empty(spark, tmp_path):
    tok = {"text": "a", "lang": "A", "cls": "C1", "conf": 0.9, "start_ms": 0, "end_ms": 5}
    u = [{"utterance_id": i, "speaker_id": "s", "session_id": "x", "transcript": "t", "tokens": k} for i, k in (("u1", [tok, tok]), ("u2", []), ("u3", None))]
    doc = {"manifest_version": 1, "provenance": "recorded", "speakers": [{"speaker_id": "s", "consent": True}], "sessions": [{"session_id": "x", "speaker_id": "s"}], "utterances": u}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    m = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert {r.utterance_id: r.n_tokens for r in m["utterances"].collect()} == {"u1": 2, "u2": 0, "u3": None}
    files.write_utterances(m["utterances"], m["tokens"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception):
        files.write_utterances(m["utterances"], m["tokens"], str(tmp_path / "out"))
    (tmp_path / "bad.json").write_text(json.dumps({**doc, "manifest_version": 9}))
    with pytest.raises(Exception):
        files.read_manifest(spark, str(tmp_path / "bad.json"))["utterances"].count()


def test_logs_sheets_gold_and_runs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"clip_id": "a", "n": 1}\n{"clip_id": "b", "n": 2}\n{"clip_id": "c", "n"')
    rows, broken = files.read_log(spark, str(tmp_path / "log.jsonl"), "clip_id string, n int")
    assert rows.count() == 2 and broken.count() == 1
    (tmp_path / "gold.tsv").write_text("# prefilled: yes\nutterance_id\tidx\ttoken\tlang\tcls\tnote\nu\t0\tx\ta\tC1\t\nu\t1\ty\tqq\tC1\t\nu\t2\tz\t\t\t\n")
    good, bad = files.read_gold(spark, str(tmp_path / "gold.tsv"), ["A", "B"])
    assert [(r.idx, r.lang) for r in good.orderBy("idx").collect()] == [(0, "A"), (2, None)] and bad.count() == 1
    (tmp_path / "sheet.csv").write_text("speaker_id,session_id,environment\n s1 ,,quiet\n,S2,quiet\ns3,S2,space\n")
    assert [(r.speaker_id, r.session_id, r.environment) for r in files.read_sheet(spark, str(tmp_path / "sheet.csv"), ["quiet"]).orderBy("speaker_id").collect()] == [("s1", "S1", "quiet"), ("s3", "S2", None)]
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "results.json").write_text(json.dumps({"eer": 0.1}, indent=1))
    assert {r.run for r in files.read_runs(spark, str(tmp_path / "runs/*/results.json")).collect()} == {"r1", "r2"}


def test_vector_table_refuses_to_overwrite(spark, tmp_path):
    v = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])], "vec_id long, source string, v array<double>")
    path = str(tmp_path / "vectors")
    files.write_vectors(v, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("vec_id", "source", "v").collect()) == [(1, "a", [1.0, 2.0]), (2, "b", [3.0, 4.0])]
    with pytest.raises(Exception, match="already exists"):
        files.write_vectors(v, path)
