"""Vector code compression: a codebook for each part of the vectors, fitted over anchors-hierarchy metric trees.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook whose entries are moved to the means of their parts.
Vectors are read in blocks; in each block every part position gets a metric
tree built middle out: anchors are set at the point that is furthest from its
own anchor, points go over to a new anchor that is nearer (only those further
than half the distance between the anchors are looked at), close anchors are
merged pairwise up to a root, and large ones are split in the same way below.
Each ball has a centre, a radius, and the sum and count of its points. A pass
goes down all trees level by level with a list of candidate entries for each
ball: an entry goes from the list when another is nearer at every place of the
ball, children inherit what is left, and a ball with one candidate is owned
whole: its sum and count go to the entry at once. The parts of undecided
leaves are compared with their candidates one by one. Blocks with their trees
are built once and kept in a table in the shared folder; a round sends 64
entries a part out and gets sums and counts back, aggregated before and by
the shuffle. Arithmetic that decides is in 64-bit integers, so codes equal
those of a comparison with all entries; floating-point bounds only discard
entries that are further by more than their rounding error.

Defined cases: rows whose vector is null or holds a null or non-finite
component are left out; components are held to 24 bits (65,536 in size), which
keeps squared distances in 64 bits; the codebook starts from the rows with
the 64 smallest distinct ids (of rows with one id the smallest vector), null
ids never; fewer rows give fewer entries. A vector whose length is not that of
these rows (of the smallest id), or no multiple of the number of parts, has no
code and no error. Rows that repeat are coded each. Null ids and labels are
kept; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilens.llm.common import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LARGEST = 1 << 24
#: Vectors in a block, and points below which a ball isn't split.
BLOCK, LEAF = 8192, 64
#: Labels up to which the table of their errors is broadcast.
BROADCAST_ROWS = 500_000


def _kept(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x): integer components of the vectors that count."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE).cast("long"))).cast("int"))
    return df.filter(good).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("x"))


def start(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first codebooks (parts, entries, width) from the rows with the smallest ids; at most ``entries`` rows reach the driver."""
    fits = kept.filter("vec_id IS NOT NULL")
    one = fits.select("vec_id", F.size("x").alias("n"), "x").orderBy("vec_id", "x").limit(1).collect()
    if not one or one[0].n == 0 or one[0].n % parts:
        return np.zeros((parts, 0, 0), np.int64)
    rows = fits.filter(F.size("x") == one[0].n).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


# --- trees -----------------------------------------------------------------

def _length(d: np.ndarray) -> np.ndarray:
    """Euclidean length of each row."""
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each point, point of each anchor): up to k anchors, each set at the point furthest from its own one."""
    own, to = np.zeros(len(x), np.int32), _length(x - x[0])
    at = [0]
    while len(at) < k:
        far = int(to.argmax())
        if to[far] == 0:
            break
        apart = _length(x[at] - x[far])
        near = np.flatnonzero(to > apart[own] / 2)
        d = _length(x[near] - x[far])
        won = d < to[near]
        near = near[won]
        own[near], to[near] = len(at), d[won]
        at.append(far)
    return own, np.array(at)


def _merged(centre: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to merge, in order: each time the two whose common ball is smallest. The i-th pair makes ball n + i."""
    n = len(radius)
    c, r = np.zeros((2 * n - 1, centre.shape[1])), np.zeros(2 * n - 1)
    c[:n], r[:n] = centre, radius
    size = np.full((2 * n - 1, 2 * n - 1), np.inf)

    def common(i: int, js: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(r[i], r[js]), (_length(c[js] - c[i]) + r[i] + r[js]) / 2)

    live = np.arange(2 * n - 1) < n
    for i in range(1, n):
        size[i, :i] = common(i, np.arange(i))
    pairs = []
    for new in range(n, 2 * n - 1):
        a, b = divmod(int(size[:new, :new].argmin()), new)
        gap = float(np.sqrt(((c[a] - c[b]) ** 2).sum()))
        r[new] = size[a, b]
        c[new] = c[a] if gap == 0 else c[a] + (c[b] - c[a]) * min(max((r[new] - r[a]) / gap, 0.0), 1.0)
        pairs.append((a, b))
        live[[a, b]] = False
        size[[a, b], :] = np.inf
        size[:, [a, b]] = np.inf
        js = np.flatnonzero(live[:new])
        size[new, js] = common(new, js)
        live[new] = True
    return pairs


def tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, nodes): a node is (first, end, left, right), children after their parents, leaves with left -1.

    Each ball's points lie together in the order.
    """
    f = x.astype(np.float64)
    order: list[np.ndarray] = []
    nodes: list[list[int]] = []
    placed = 0
    todo: list[tuple[str, object, int, int]] = [("split", np.arange(len(x)), -1, 0)]

    def node(parent: int, side: int) -> int:
        nodes.append([placed, placed, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        return len(nodes) - 1

    while todo:  # depth first, so that a ball's points are placed one after another
        kind, what, parent, side = todo.pop()
        if kind == "merge":
            members, pairs, ball = what
            if ball < len(members):
                todo.append(("split", members[ball], parent, side))
                continue
            me, (a, b) = node(parent, side), pairs[ball - len(members)]
            todo += [("merge", (members, pairs, b), me, 1), ("merge", (members, pairs, a), me, 0)]
            continue
        if len(what) > LEAF:
            own, at = _anchors(f[what], max(2, int(np.sqrt(len(what)))))
            if len(at) > 1:
                by = np.argsort(own, kind="stable")
                members = np.split(what[by], np.cumsum(np.bincount(own, minlength=len(at)))[:-1])
                centre = f[what[at]]
                radius = np.maximum.reduceat(_length(f[what[by]] - centre[own[by]]), np.flatnonzero(np.r_[True, np.diff(own[by]) > 0]))
                todo.append(("merge", (members, _merged(centre, radius), 2 * len(members) - 2), parent, side))
                continue
        me = node(parent, side)
        order.append(what)
        placed += len(what)
        nodes[me][1] = placed
    made = np.array(nodes, np.int32).reshape(-1, 4)
    for i in range(len(made) - 1, -1, -1):
        if made[i, 2] >= 0:
            made[i, 1] = made[made[i, 3], 1]
    return (np.concatenate(order) if order else np.zeros(0, np.int64)), made


def balls(x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, radius, sum) of each node over the ordered points: the mean in 32-bit floats, and a radius that covers every point from there.

    The radius of a leaf is that of its points, that of a larger ball covers its two children.
    """
    before = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0)])
    total = before[nodes[:, 1]] - before[nodes[:, 0]]
    centre = (total / np.maximum(nodes[:, 1] - nodes[:, 0], 1)[:, None]).astype(np.float32)
    c, radius = centre.astype(np.float64), np.zeros(len(nodes))
    leaf = np.flatnonzero(nodes[:, 2] < 0)
    own = np.repeat(leaf, nodes[leaf, 1] - nodes[leaf, 0])
    if len(own):
        radius[leaf] = np.maximum.reduceat(_length(x - c[own]), nodes[leaf, 0])
    depth = np.zeros(len(nodes), np.int32)
    inner = np.flatnonzero(nodes[:, 2] >= 0)
    for i in inner:
        depth[nodes[i, 2:]] = depth[i] + 1
    for level in range(int(depth.max(initial=0)), -1, -1):
        at = inner[depth[inner] == level]
        below = [_length(c[at] - c[nodes[at, side]]) + radius[nodes[at, side]] for side in (2, 3)]
        radius[at] = np.maximum(*below)
    return centre, np.nextafter((radius * (1 + 1e-6)).astype(np.float32), np.float32(np.inf)), total


def _walk(x: np.ndarray, nodes: np.ndarray, centre: np.ndarray, radius: np.ndarray, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(owned: (nodes, entries) by level; points of undecided leaves; their entries)."""
    e = book.astype(np.float64)
    between = np.sqrt(((e[:, None, :] - e[None, :, :]) ** 2).sum(2))
    scale = (e * e).sum(1)
    owned, points, picks = [], [], []
    at, mask = np.zeros(min(1, len(nodes)), np.int64), np.ones((min(1, len(nodes)), len(e)), bool)
    while len(at):
        c = centre[at].astype(np.float64)
        d = np.square(c[:, None, :] - e[None, :, :]).sum(2)
        best = np.where(mask, d, np.inf).argmin(1)
        size = (c * c).sum(1)[:, None] + scale[None, :] + d[np.arange(len(at)), best][:, None]
        mask &= d[np.arange(len(at)), best][:, None] - d + 2 * radius[at].astype(np.float64)[:, None] * between[best] >= -1e-9 * size
        mask[np.arange(len(at)), best] = True
        single = mask.sum(1) == 1
        owned.append((at[single], best[single]))
        rest, left = at[~single], mask[~single]
        leaf = nodes[rest, 2] < 0
        if leaf.any():
            p, k = _compared(x, nodes[rest[leaf]], left[leaf], book)
            points.append(p)
            picks.append(k)
        inner = rest[~leaf]
        at, mask = np.concatenate([nodes[inner, 2], nodes[inner, 3]]).astype(np.int64), np.concatenate([left[~leaf], left[~leaf]])
    none = np.zeros(0, np.int64)
    return owned, np.concatenate(points) if points else none, np.concatenate(picks) if picks else none


def _compared(x: np.ndarray, leaves: np.ndarray, mask: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, entries): the points of the leaves, each with the nearest of the leaf's candidates, of equally near ones the first."""
    n, k = leaves[:, 1] - leaves[:, 0], mask.sum(1)
    points = np.repeat(leaves[:, 0] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    of = np.repeat(np.arange(len(leaves)), n)  # leaf of each point
    first = np.r_[0, np.cumsum(k)[:-1]]
    entries = np.nonzero(mask)[1]
    per = k[of]
    start_at = np.r_[0, np.cumsum(per)[:-1]]
    pair = np.repeat(first[of] - start_at, per) + np.arange(per.sum())
    cand = entries[pair]
    gap = x[np.repeat(points, per)] - book[cand]
    d = np.einsum("ij,ij->i", gap, gap)
    low = np.minimum.reduceat(d, start_at)
    pick = np.minimum.reduceat(np.where(d == np.repeat(low, per), cand, len(book)), start_at)
    return points, pick


def assigned(x: np.ndarray, nodes: np.ndarray, centre: np.ndarray, radius: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each ordered point."""
    codes = np.zeros(len(x), np.int64)
    owned, points, picks = _walk(x, nodes, centre, radius, book)
    for at, entry in owned:
        n = nodes[at, 1] - nodes[at, 0]
        spots = np.repeat(nodes[at, 0] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        codes[spots] = np.repeat(entry, n)
    codes[points] = picks
    return codes


def summed(x: np.ndarray, nodes: np.ndarray, centre: np.ndarray, radius: np.ndarray, total: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(entries, 1 + width): count and sum of the points nearest to each entry; owned balls add what they have cached."""
    out = np.zeros((len(book), 1 + x.shape[1]), np.int64)
    owned, points, picks = _walk(x, nodes, centre, radius, book)
    for at, entry in owned:
        np.add.at(out, (entry, 0), nodes[at, 1] - nodes[at, 0])
        np.add.at(out, (entry, slice(1, None)), total[at])
    np.add.at(out, (picks, 0), 1)
    np.add.at(out, (picks, slice(1, None)), x[points])
    return out


# --- the job ---------------------------------------------------------------

_BLOCKS = "vec_ids binary, labels binary, n int, trees array<struct<x:binary, wide:boolean, place:binary, nodes:binary, centre:binary, radius:binary, total:binary>>"


def _pack(x: np.ndarray) -> dict:
    order, nodes = tree(x)
    x = x[order]
    centre, radius, total = balls(x, nodes)
    wide = bool(len(x) and np.abs(x).max() >= 1 << 15)
    return {"x": x.astype("<i4" if wide else "<i2").tobytes(), "wide": wide, "place": order.astype("<i2" if len(x) <= 1 << 15 else "<i4").tobytes(), "nodes": nodes.tobytes(),
            "centre": centre.tobytes(), "radius": radius.tobytes(), "total": total.tobytes()}


def _unpack(t: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(t["x"], "<i4" if t["wide"] else "<i2").astype(np.int64).reshape(-1, width)
    nodes = np.frombuffer(t["nodes"], np.int32).reshape(-1, 4)
    return x, nodes, np.frombuffer(t["centre"], np.float32).reshape(-1, width), np.frombuffer(t["radius"], np.float32), np.frombuffer(t["total"], np.int64).reshape(-1, width)


def _ipc(array: pa.Array) -> bytes:
    """A column of any type as bytes, so that ids and labels keep their types within a block."""
    batch = pa.record_batch([array], ["v"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _column(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()


def blocks(kept: DataFrame, length: int, parts: int) -> DataFrame:
    """Blocks of vectors of one length with a tree for each part position."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_ids", pa.binary()), ("labels", pa.binary()), ("n", pa.int32()), ("trees", pa.list_(pa.struct([
            ("x", pa.binary()), ("wide", pa.bool_()), ("place", pa.binary()), ("nodes", pa.binary()), ("centre", pa.binary()), ("radius", pa.binary()), ("total", pa.binary())])))])

        def made(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            x = rows.column("x").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, parts, length // parts)
            trees = [_pack(np.ascontiguousarray(x[:, p])) for p in range(parts)]
            one = lambda name: _ipc(rows.column(name).combine_chunks())
            return pa.RecordBatch.from_pylist([{"vec_ids": one("vec_id"), "labels": one("label"), "n": rows.num_rows, "trees": trees}], schema=schema)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield made(rows.slice(0, BLOCK))
                held = rows.slice(BLOCK).to_batches()
                n -= BLOCK
        if n:
            yield made(pa.Table.from_batches(held))

    return kept.filter(F.size("x") == length).select("vec_id", "label", "x").mapInArrow(build, _BLOCKS)


def moved(made: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry at the floor of the mean of its parts, unused ones where they were."""
    width = book.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((*book.shape[:2], 1 + width), np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                for p, t in enumerate(row):
                    out[p] += summed(*_unpack(t, width), book[p])
        p, k, at = np.nonzero(out)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(out[p, k, at], pa.int64())], ["part", "entry", "at", "value"])

    found = made.select("trees").mapInArrow(sums, "part int, entry int, at int, value long").groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((*book.shape[:2], 1 + width), np.int64)
    for r in found:  # at most parts x entries x (1 + width) rows
        total[r.part, r.entry, r.at] = r.value
    n = total[:, :, :1]
    return np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), book)


def coded(made: DataFrame, book: np.ndarray, kept: DataFrame) -> DataFrame:
    """(vec_id, label, code, error) of every vector in the blocks."""
    width = book.shape[2]
    types = {f.name: f.dataType.simpleString() for f in kept.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vec_ids, labels, n, trees in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, error = np.zeros((n, len(trees)), np.uint8), np.zeros(n, np.int64)
                for p, t in enumerate(trees):
                    x, nodes, centre, radius, total = _unpack(t, width)
                    got = assigned(x, nodes, centre, radius, book[p])
                    place = np.frombuffer(t["place"], "<i2" if n <= 1 << 15 else "<i4")
                    codes[place, p] = got
                    error[place] += np.square(x - book[p][got]).sum(1)
                text = codes.tobytes().hex()
                wide = 2 * len(trees)
                yield pa.record_batch([_column(vec_ids), _column(labels), pa.array([text[i:i + wide] for i in range(0, len(text), wide)]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return made.mapInArrow(code, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
               id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of each vector that counts, the codebooks (parts, entries, width)). At most 256 entries a part."""
    if entries > 256:
        raise ValueError("a code byte names at most 256 entries")
    kept = _kept(df, id_col, vector_col, label_col)
    book = start(kept, parts, entries)
    uncoded = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.size("x").alias("n"))
    if book.size == 0:
        return uncoded.drop("n"), book
    length = parts * book.shape[2]
    made = stored(blocks(kept, length, parts), "trees")
    for _ in range(rounds):
        book = moved(made, book)
    return coded(made, book, kept).unionByName(uncoded.filter(F.col("n") != length).drop("n")), book


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the sum of the errors over equal labels, nulls together."""
    codes = stored(codes, "codes")
    total = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    small = F.broadcast(total) if total.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else total
    return codes.join(small, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL that compares every part with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, arg_min(k, d * 1000 + k) AS k, min(d) AS d
            FROM (SELECT p.vec_id, p.part, c.k, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, c.x)])::BIGINT AS d FROM p JOIN c{r} c USING (part)) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, k, i, floor(sum(v) / count(*))::BIGINT AS v FROM (SELECT part, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM p JOIN a{r} USING (vec_id, part)) GROUP BY ALL),
            n{r} AS (SELECT part, k, list(v ORDER BY i) AS x FROM m{r} GROUP BY ALL),
            c{r + 1} AS (SELECT part, k, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n USING (part, k))""")
    last = rounds
    return f"""
        WITH kept AS (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
                      WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        p AS (SELECT vec_id, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM kept, range({parts}) t(part)),
        c0 AS (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p QUALIFY k < {entries}),
        {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(lower(printf('%02x', k)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY ALL),
        book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, k, i)) AS h FROM (SELECT part, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM c{last}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (vec_id), book"""
