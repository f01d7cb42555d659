"""Gated recurrent language model with a class-factored output.

Tokens are words between ASCII white space with A-Z lower-cased, then one end
per text. Counts of all training tokens give the base score (additive
smoothing) and the model's distributions within rare classes. The model is a
gated recurrent network over the previous tokens:
P(token) = P(class | state) P(token | class). The ``TOP`` most frequent tokens
form ``TOP / WIDE`` classes by frequency, with a softmax of the state inside the class;
all other words fall into ``TAIL`` classes by their last two bytes, inside
which counts decide, smoothed as in the base score.

Training: the training rows are dealt to ``ROUNDS`` rounds by a hash of id and
text, so that every row is trained on once and copies are spread; every task
trains on its share of a round by truncated backpropagation in numpy, state
carried from window to window; after each round weights are averaged by tokens
seen. Counting covers all training texts; what both read and send grows with the corpus. Scoring carries the state
through a whole text. Texts of any length are scored whole.

Counts of the ``FREQUENT`` most frequent tokens go to all tasks (a bounded
table); other words of a text are joined to the counts by a shuffle.

Defined cases: a null text counts as empty and is one end; a null id counts as
an empty one in the choice of held-out texts (so it is held out); without
training texts every count is 0, scores use N = 0; repeated rows are scored
each by itself; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import stored, text_of

HIDDEN, TOP, WIDE, TAIL = 16, 1024, 32, 32
FREQUENT = 1 << 18
WINDOW, LANES, SEGMENT = 16, 1024, 256
ROUNDS, RATE = 2, 0.03
#: Weights of the output stay within this, so that with states below 1 no exponential overflows.
MOST = 4.0
#: Tokens of texts that a task scores side by side, and how many at most side by side.
POOL, ABREAST = 5_000_000, 512
SMOOTH = 0.1
END = b""
CLASSES = TOP // WIDE + TAIL
#: Words of a partial count that a task holds at once.
PARTIAL = 400_000
BLOCK = 4096
_TAIL_FIRST = TOP // WIDE


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, split at ASCII white space (space, tab to carriage return)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) & (TAIL - 1)


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


# ---- the network ----

def blank(class_bias: np.ndarray, word_bias: np.ndarray) -> dict[str, np.ndarray]:
    """First weights: small random ones; the output starts as the unigram distribution."""
    rng, h, g = np.random.default_rng(11), HIDDEN, 3 * HIDDEN
    put = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
    return {"E": put(TOP + TAIL + 1, g), "U": put(h, g, s=0.25), "b": np.zeros(g, np.float32), "C": put(h, CLASSES), "c": class_bias.astype(np.float32),
            "W": put(TOP, h), "w": word_bias.astype(np.float32)}


def step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One token of each lane: new state, and what backpropagation needs."""
    n = HIDDEN
    e = p["E"][x]
    e += p["b"]
    hu = h @ p["U"]
    zr = e[:, :2 * n] + hu[:, :2 * n]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:, :n], zr[:, n:]
    new = np.tanh(e[:, 2 * n:] + r * hu[:, 2 * n:])
    return new + z * (h - new), z, r, new, hu


def output(p: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log chance of each target's class and, for frequent tokens, of the token in it; with ``grads`` also d(-sum)/d states."""
    group = np.where(target < TOP, target // WIDE, _TAIL_FIRST + target - TOP)
    logits = states @ p["C"]
    logits += p["c"]
    at = np.arange(len(target))
    chosen = logits[at, group]
    e = np.exp(logits, out=logits)
    total = e.sum(1)
    out = chosen - np.log(total)
    d_states = None
    if grads is not None:
        d = np.divide(e, total[:, None], out=e)
        d[at, group] -= 1
        grads["C"] += states.T @ d
        grads["c"] += d.sum(0)
        d_states = d @ p["C"].T
    order = np.argsort(group.astype(np.uint8), kind="stable")  # small numbers are sorted by their digits
    ends = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=_TAIL_FIRST))))
    for k in range(_TAIL_FIRST):
        rows = order[ends[k]:ends[k + 1]]
        if not len(rows):
            continue
        own = slice(k * WIDE, (k + 1) * WIDE)
        s = states[rows]
        inside = s @ p["W"][own].T
        inside += p["w"][own]
        i, t = at[:len(rows)], target[rows] - k * WIDE
        chosen = inside[i, t]
        e = np.exp(inside, out=inside)
        total = e.sum(1)
        out[rows] += chosen - np.log(total)
        if grads is not None:
            d = np.divide(e, total[:, None], out=e)
            d[i, t] -= 1
            grads["W"][own] += d.T @ s
            grads["w"][own] += d.sum(0)
            d_states[rows] += d @ p["W"][own]
    return out, d_states


def window_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], float, np.ndarray]:
    """Gradient of the mean loss over a window (time by lanes), its loss, and the state after it. ``first``: a text starts here, state 0.

    ``live`` marks the places that hold a token; the others are at the ends of lanes and have no loss.
    """
    n, (steps, lanes) = HIDDEN, x.shape
    kept, states = [], np.empty((steps, lanes, n), np.float32)
    for t in range(steps):
        h = np.where(first[t][:, None], np.float32(0), h)
        new_h, z, r, new, hu = step(p, x[t], h)
        kept.append((h, z, r, new, hu))
        states[t] = h = new_h
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    if live is None:
        logs, d_states = output(p, states.reshape(-1, n), y.reshape(-1), grads)
    else:
        d_states = np.zeros((steps * lanes, n), np.float32)
        logs, d_states[live.reshape(-1)] = output(p, states[live], y[live], grads)
    d_states = d_states.reshape(steps, lanes, n)
    d_h, d_es = np.zeros((lanes, n), np.float32), np.empty((steps, lanes, 3 * n), np.float32)
    for t in range(steps - 1, -1, -1):
        old, z, r, new, hu = kept[t]
        d = d_states[t] + d_h
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (old - new) * z * (1 - z)
        d_r = d_new * hu[:, 2 * n:] * r * (1 - r)
        d_es[t] = np.concatenate([d_z, d_r, d_new], 1)
        d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
        grads["U"] += old.T @ d_hu
        d_h = np.where(first[t][:, None], np.float32(0), d * z + d_hu @ p["U"].T)
    flat = d_es.reshape(-1, 3 * n)
    order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
    ids = x.reshape(-1)[order]
    begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    grads["E"][ids[begin]] += np.add.reduceat(flat[order], begin)
    grads["b"] += flat.sum(0)
    size = len(logs)
    return {k: g / size for k, g in grads.items()}, -float(logs.mean()), h


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0

    def __call__(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        fix = np.float32(RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, a in g.items():
            a = a * scale
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (a - m)
            v += np.float32(0.01) * (a * a - v)
            p[k] -= fix * m / (np.sqrt(v) + np.float32(1e-6))
            if k in "CW":
                np.clip(p[k], -MOST, MOST, out=p[k])


def train_on(p: dict[str, np.ndarray], texts: Iterator[np.ndarray]) -> int:
    """Truncated backpropagation through the texts' ids, in segments dealt to lanes; returns the tokens seen."""
    adam, seen = Adam(p), 0

    def run(streams: list[list[np.ndarray]]) -> int:
        x = [np.concatenate([np.concatenate([[TOP + TAIL], s[:-1]]) for s in own]) for own in streams]
        y = [np.concatenate(own) for own in streams]
        starts = []
        for own in streams:
            f = np.zeros(sum(map(len, own)), bool)
            f[np.cumsum([0, *map(len, own[:-1])])] = True
            starts.append(f)
        ends = np.array([len(a) for a in y])
        full = np.zeros((3, ends.max(), len(ends)), np.int32)
        for i, lane in enumerate(zip(x, y, starts, strict=True)):
            full[:, :ends[i], i] = lane
        x, y, f = full[0], full[1], full[2].astype(bool)
        h = np.zeros((len(streams), HIDDEN), np.float32)
        for a in range(0, len(x), WINDOW):
            on = ends > a  # a lane that has ended is left out
            live = np.arange(a, min(a + WINDOW, len(x)))[:, None] < ends[on]
            own = (z[a:a + WINDOW, on] for z in (x, y, f))
            g, _, h[on] = window_gradient(p, *own, h[on], None if live.all() else live)
            # a window of few tokens counts by what it holds, not as a full one
            adam(p, {k: v * np.float32(live.sum() / (min(WINDOW, len(x)) * len(ends))) for k, v in g.items()})
        return int(ends.sum())

    held: list[np.ndarray] = []
    size = 0
    for ids in texts:
        held.extend(np.array_split(ids, -(-len(ids) // SEGMENT)))
        size += len(ids)
        if size >= LANES * SEGMENT * 2:
            seen += run(_dealt(held, LANES))
            held, size = [], 0
    if held:
        seen += run(_dealt(held, max(1, min(LANES, size // SEGMENT))))
    return seen


def _dealt(parts: list[np.ndarray], lanes: int) -> list[list[np.ndarray]]:
    """Longest first to the shortest lane; lanes that got nothing are left out."""
    out: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    size = np.zeros(lanes, int)
    for part in sorted(parts, key=len, reverse=True):
        to = int(size.argmin())
        out[to].append(part)
        size[to] += len(part)
    return [own for own in out if own]


def score_all(p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural log chance of each text's classes and frequent tokens, the state carried through the whole text."""
    result = np.zeros(len(texts))
    if not texts:
        return result
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lanes: list[list[int]] = [[] for _ in range(min(ABREAST, len(texts)))]
    size = np.zeros(len(lanes), int)
    for i in order:
        to = int(size.argmin())
        lanes[to].append(i)
        size[to] += len(texts[i])
    rank = np.argsort(-size, kind="stable")
    lanes, size = [lanes[i] for i in rank], size[rank]
    flat = [i for own in lanes for i in own]
    y = np.concatenate([texts[i] for i in flat])
    owner = np.repeat(np.array(flat, np.int32), [len(texts[i]) for i in flat])
    x = np.empty_like(y)
    x[1:] = y[:-1]
    new = np.ones(len(y), bool)
    new[1:] = owner[1:] != owner[:-1]
    x[new] = TOP + TAIL
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    states, places = [], []
    held = 0

    def flush() -> None:
        at = np.concatenate(places)
        logs, _ = output(p, np.concatenate(states), y[at])
        result[:] += np.bincount(owner[at], logs, len(texts))

    alive = len(lanes)
    for t in range(int(size[0])):
        while size[alive - 1] <= t:
            alive -= 1
        at = base[:alive] + t
        h = h[:alive]
        begins = new[at]
        if begins.any():
            h[begins] = 0
        h = step(p, x[at], h)[0]
        states.append(h)
        places.append(at)
        held += alive
        if held >= 30_000:
            flush()
            states, places, held = [], [], 0
    if held:
        flush()
    return result


# ---- on Spark ----

def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": list(n.keys()), "c": list(n.values())})

    for df in batches:
        for text in df["text"]:
            n.update(tokens(text))
            n[END] += 1
            if len(n) >= PARTIAL:
                yield out()
                n.clear()
    if n:
        yield out()


class Vocabulary:
    """What all tasks know: the frequent tokens with their counts, and the sums of each tail class."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        self.words = {w: i for i, (w, _) in enumerate(frequent)}
        self.counts = np.array([c for _, c in frequent], float)
        self.total, self.distinct = total, distinct
        n, v = (np.array([tails.get(k, (0, 0))[i] for k in range(TAIL)], float) for i in (0, 1))
        self.tail_log = np.log10(n + SMOOTH * (v + 1))  # log of the denominator inside a tail class
        self.tail_n = n
        self.ids = np.array([i if i < TOP else TOP + tail_class(w) for i, (w, _) in enumerate(frequent)], np.int32)
        self.log_count = np.log10(self.counts + SMOOTH)
        self.base_log = float(np.log10(total + SMOOTH * (distinct + 1)))

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        top = np.zeros(TOP)
        top[:min(TOP, len(self.counts))] = self.counts[:TOP]
        groups = np.concatenate([top.reshape(-1, WIDE).sum(1), self.tail_n])
        return np.log(groups + SMOOTH) - np.log(groups.sum() + SMOOTH), np.log(top + SMOOTH)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of a text: ids of tokens for the network, places of frequent tokens in the table, and the other words."""
        get = self.words.get
        words = tokens(text)
        words.append(END)
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(at < 0)
        ids = self.ids[at] if len(self.ids) else np.zeros(len(at), np.int32)
        others = [words[i] for i in rare.tolist()]
        if others:
            ids[rare] = [TOP + tail_class(w) for w in others]
        return ids, at[at >= 0], others


def _weights_rows(p: dict[str, np.ndarray], seen: int) -> pd.DataFrame:
    flat = np.concatenate([p[k].reshape(-1) for k in sorted(p)]).astype(np.float64) * seen
    blocks = [flat[a:a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
    return pd.DataFrame({"block": range(len(blocks)), "part": TaskContext.get().partitionId() % 256, "seen": seen, "sums": blocks})


def _summed(df: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in df["sums"])
    return pd.DataFrame({"block": [df["block"].iloc[0]], "part": [0], "seen": [df["seen"].sum()], "sums": [total.tobytes()]})


def in_round(rows: DataFrame, now: int) -> DataFrame:
    """The rows (id, text) of one of ``ROUNDS`` rounds; each row is in one of them."""
    return rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == now)


def train(rows: DataFrame, vocabulary: Vocabulary, sent) -> dict[str, np.ndarray]:
    """Weights after ``ROUNDS`` rounds over the training rows (id, text)."""
    p = blank(*vocabulary.biases())
    schema = "block int, part int, seen long, sums binary"
    for now in range(ROUNDS):
        given = {k: v.copy() for k, v in p.items()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = {k: v.copy() for k, v in given.items()}  # noqa: B023
            seen = train_on(own, (sent.value.read(text)[0] for df in batches for text in df["text"]))
            if seen:
                yield _weights_rows(own, seen)

        parts = in_round(rows, now).select("text").mapInPandas(run, schema).groupBy("block", "part").applyInPandas(_summed, schema).groupBy("block").applyInPandas(_summed, schema)
        got = sorted(parts.collect(), key=lambda r: r.block)  # one row per block of weights
        if not got:
            continue
        flat = np.concatenate([np.frombuffer(r.sums) / r.seen for r in got])
        at = 0
        for k in sorted(p):
            p[k] = flat[at:at + p[k].size].reshape(p[k].shape).astype(np.float32)
            at += p[k].size
    return p


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), is_held_out(id_col).alias("held_out"))
    learn = rows.filter(~F.col("held_out")).select("id", "text")
    counts = stored(learn.select("text").mapInPandas(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()  # bounded
    frequent = list(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True))
    all_tails = counts.groupBy(F.crc32(F.substring("word", -2, 2)).bitwiseAND(F.lit(TAIL - 1)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tails = {r.k: [r.n, r.v] for r in all_tails}
    for w, c in frequent[:TOP]:
        tails[tail_class(w)][0] -= c
        tails[tail_class(w)][1] -= 1
    vocabulary = Vocabulary(frequent, sums.n, sums.v, tails)
    sent = spark.sparkContext.broadcast(vocabulary)
    weights = train(learn, vocabulary, sent)
    net = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, p, number = sent.value, net.value, TaskContext.get().partitionId() << 40
        ids, out, size = [], [], 0

        def flush() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=["row", "id", "held_out", "n_tokens", "known", "log_count", "log_tail", "rare"])
            return df.assign(net=score_all(p, ids) / np.log(10))

        for df in batches:
            for id_, text, held in zip(df["id"], df["text"], df["held_out"], strict=True):
                own, at, rare = v.read(text)
                tail = own >= TOP
                known_tail = at[at >= TOP]
                out.append((number, id_, held, len(own), len(at), float(v.log_count[at].sum()), float(v.log_count[known_tail].sum() - v.tail_log[own[tail] - TOP].sum()), rare))
                ids.append(own)
                number, size = number + 1, size + len(own)
                if size >= POOL:
                    yield flush()
                    ids, out, size = [], [], 0
        if out:
            yield flush()

    made = stored(rows.withColumn("id", F.col("id").cast("string")).mapInPandas(
        score, "row long, id string, held_out boolean, n_tokens long, known long, log_count double, log_tail double, rare array<binary>, net double"), "scored")
    words = made.select("row", F.explode("rare").alias("word"))
    rest = words.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("rare_log"), F.count("c").alias("rare_known"))
    done = made.drop("rare").join(rest, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return done.select(
        F.col("id").cast(id_type).alias("id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("log_count") + rare_log - F.col("n_tokens") * F.lit(vocabulary.base_log)).alias("base_score"),
        (F.col("net") + F.col("log_tail") + rare_log).alias("score"))
