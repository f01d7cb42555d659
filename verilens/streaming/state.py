"""Keyed state on streams. The batch operators define the results; once the watermark has passed, these equal them.

The three stateful operators are processors of ``transformWithState``: arrivals
wait in a buffer of their key until the watermark has passed them, so that the
order in which they arrive (within the delay) changes nothing, and event-time
timers release, expire and clear. State per key is what came within the delay
plus the memory that the rule defines.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from verilens.operators.fusion import Policy, decide
from verilens.operators.state import Throttle

#: State store that ``transformWithState`` needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    """Set the state store of stateful processors for this session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _after(us: int) -> int:
    """The first millisecond at which everything up to this microsecond has come."""
    return us // 1000 + 1


def _rows(value) -> list[tuple]:
    return [tuple(r) for r in value.get()] if value.exists() else []


class _Throttled(StatefulProcessor):
    """Attempts wait until the watermark passes them, then meet the failures that are live at their time."""

    def __init__(self, rule: Throttle):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, failed boolean")
        self.failures = handle.getListState("failures", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for df in rows:
            for us, ident, failed in zip(df["us"], df["id"], df["failed"], strict=True):
                self.waiting.appendValue((int(us), int(ident), bool(failed)))
                due.add(_after(int(us)))
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        span = self.rule.forget * 1_000_000
        held = sorted(_rows(self.waiting))
        ready = [r for r in held if _after(r[0]) <= now]
        live = deque(t for (t,) in _rows(self.failures))
        out, at = [], 0
        while at < len(ready):  # attempts at one instant don't see each other
            us = ready[at][0]
            to = at
            while to < len(ready) and ready[to][0] == us:
                to += 1
            while live and live[0] <= us - span:
                live.popleft()
            over = len(live) - self.rule.free
            wait = max(0.0, (live[-1] - us) / 1e6 + min(self.rule.maximum, self.rule.base * 2.0 ** (over - 1))) if over > 0 else 0.0
            same = ready[at:to]
            out += [(key[0], ident, len(live), wait) for _, ident, _ in same]
            if all(failed for _, _, failed in same):
                live.extend([us] * len(same))
            else:
                live.clear()
            at = to
        if ready:
            self._put(self.waiting, held[len(ready):])
            if live:
                self.handle.registerTimer(_after(live[-1] + span))
        else:
            while live and _after(live[0] + span) <= now:
                live.popleft()
        self._put(self.failures, [(t,) for t in live])
        if out:
            yield pd.DataFrame(out, columns=["identity", "id", "n_live", "wait"])

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def throttle(attempts: DataFrame, rule: Throttle, delay: str = "1 hour") -> DataFrame:
    """(identity, id, us, failed, ts) stream -> live failures before each attempt and the wait it must honour, when the watermark has passed it."""
    return attempts.withWatermark("ts", delay).groupBy("identity").transformWithStateInPandas(
        _Throttled(rule), "identity long, id long, n_live long, wait double", "append", "EventTime")


class _Challenges(StatefulProcessor):
    """Challenges by id with a timer at the end of their life, answers in a list until no open challenge can take them."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "challenge long", "issued long")
        self.answers = handle.getListState("answers", "us long, answer long")
        self.past = handle.getListState("past", "issued long, challenge long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for df in rows:
            for us, ident, issued in zip(df["us"], df["id"], df["is_issued"], strict=True):
                us, ident = int(us), int(ident)
                if issued:
                    self.open.updateValue((ident,), (us,))
                    self.past.appendValue((us, ident))
                else:
                    self.answers.appendValue((us, ident))
                due.add(_after(us + self.ttl))  # when a challenge ends, and when an answer is of no more use
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        answers, past = sorted(_rows(self.answers)), sorted(_rows(self.past))
        ending = sorted((us, c) for (c,), (us,) in self.open.iterator() if _after(us + self.ttl) <= now)
        out = []
        starts = [us for us, _ in past]
        for us, c in ending:
            taken = []
            for at, answer in answers[bisect_right(answers, (us, 2**63)):bisect_right(answers, (us + self.ttl, 2**63))]:
                last = past[bisect_left(starts, at) - 1]  # an answer is taken by the latest challenge before it
                if last == (us, c):
                    taken.append((at, answer))
            first = taken[0] if taken else None
            out.append((key[0], c, us, "consumed" if first else "expired", first[1] if first else None, (first[0] - us) / 1e6 if first else None, max(0, len(taken) - 1)))
            self.open.removeKey((c,))
        # what neither an open challenge nor a late one can need goes
        keep = [us for _, (us,) in self.open.iterator()]
        floor = min(keep) if keep else now * 1000
        answers = [a for a in answers if a[0] > floor or _after(a[0] + self.ttl) > now]
        past = [p for p in past if p[0] >= floor or _after(p[0] + self.ttl) > now]
        for state, rows in ((self.answers, answers), (self.past, past)):
            _Throttled._put(state, rows)
        if out:
            yield pd.DataFrame(out, columns=["identity", "challenge", "issued_us", "status", "answer", "latency", "replays"]).astype({"answer": "Int64"})

    def close(self) -> None:
        pass


def challenges(issued: DataFrame, answers: DataFrame, ttl: int, delay: str = "1 hour") -> DataFrame:
    """Each challenge once its life is over: consumed by its first answer in time, or expired; further answers are counted as replays.

    An answer serves the latest challenge before it, and each challenge serves
    one answer. ``issued`` is (identity, challenge, issued), ``answers``
    (identity, answer, answered).
    """
    us = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))").alias("us")
    both = issued.select("identity", F.col("issued").alias("ts"), us("issued"), F.col("challenge").alias("id"), F.lit(True).alias("is_issued")).unionByName(
        answers.select("identity", F.col("answered").alias("ts"), us("answered"), F.col("answer").alias("id"), F.lit(False).alias("is_issued")))
    made = both.withWatermark("ts", delay).groupBy("identity").transformWithStateInPandas(
        _Challenges(ttl), "identity long, challenge long, issued_us long, status string, answer long, latency double, replays long", "append", "EventTime")
    return made.withColumn("issued", F.timestamp_micros("issued_us")).drop("issued_us")


def first_seen(submissions: DataFrame, ts: str = "ts", window: str = "30 days") -> DataFrame:
    """First submission of each digest; repeats inside the watermark window are dropped."""
    return submissions.withWatermark(ts, window).dropDuplicatesWithinWatermark(["digest"])


class _StepUp(StatefulProcessor):
    """The latest decision of an identity, cleared when it is older than the memory."""

    def __init__(self, keep: int):
        self.keep = keep * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, id long, decision string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.last.get()) if self.last.exists() else None
        best = held
        for df in rows:
            for us, ident, decision in zip(df["us"], df["id"], df["decision"], strict=True):
                if best is None or (int(us), int(ident)) > best[:2]:
                    best = (int(us), int(ident), decision)
        if best is not None and best != held:
            self.last.update(best)
            self.handle.registerTimer(_after(best[0] + self.keep))
            yield pd.DataFrame([(key[0], best[2] == "BORDERLINE", best[1])], columns=["identity", "step_up", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            us, ident, decision = self.last.get()
            if _after(us + self.keep) <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                if decision == "BORDERLINE":
                    yield pd.DataFrame([(key[0], False, ident)], columns=["identity", "step_up", "since"])

    def close(self) -> None:
        pass


def step_up(decisions: DataFrame, keep: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """Changes of each identity's step-up flag (update mode): a borderline decision sets it, any other clears it, and so does time.

    ``decisions`` is (identity, id, decision, ts). A flag is forgotten ``keep``
    seconds after its decision, with the state behind it.
    """
    us = F.expr("unix_micros(cast(ts as timestamp))").alias("us")
    return decisions.select("identity", "id", "decision", "ts", us).withWatermark("ts", delay).groupBy("identity").transformWithStateInPandas(
        _StepUp(keep), "identity long, step_up boolean, since long", "update", "EventTime")


def score(probes: DataFrame, thresholds: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Online decisions: measured probes joined to a static table of per-speaker settings, gates, fusion, append."""
    return decide(probes.join(thresholds, "speaker"), policy)
