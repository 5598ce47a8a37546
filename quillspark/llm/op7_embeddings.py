"""Embedding near-dedup with a robust-pruned flat graph.

Vectors of one label and one length are linked if their cosine, in double precision, is `threshold` (0.93) or more.

1. Balls. Vectors of a batch that lie within half the linking angle of each other's centre are all linked, so they
   go on as one ball: centre, radius, size. A group of copies of any size becomes a few balls a batch, and counts of
   links follow from sizes where two balls are wholly within reach of each other.
2. Shards. Centres of clusters come from a bounded sample of `sample` vectors; at most `most_centres` of them are
   broadcast. Each ball is a node of the shards of its two nearest centres, so shards overlap, and asks in its
   `probes` nearest. A shard of over `shard_nodes` nodes gets centres of its own, again at most `most_centres` from a
   bounded sample, and its rows are dealt to them in the same way, the asks to half as many; these centres are never
   broadcast but meet their shard's rows in slices. What is still larger (balls in one place) is cut by a hash; its
   queries go to each part.
3. Graph. Each shard links its nodes to near ones by robust pruning: a neighbour is left out if one already taken is
   closer to it by the factor alpha. The adjacency lists of a node from all its shards are united.
4. Search. In each shard, queries walk greedily from the shard's medoid (and from their own node) with a beam, then
   expand every node within range until no more is found. What is in range is verified with the exact cosine.
5. Audit. A sample of balls is compared with all by brute force; it grows until it holds enough true pairs to tell the
   recall, or `most_audited` balls. While the recall is below `target`, the search is run again with twice the probes and
   beam, up to probing all shards of the label; a recall that stays below is an error.
6. Pairs of balls that are neither wholly in nor wholly out of reach are verified vector by vector, in tiles.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, as
do rows without label; repeated rows are vectors of their own; a null key never names a component unless all keys
of it are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import dropped, in_arrow, staged, table
from .components import components, with_smallest

THRESHOLD = 0.93
SAMPLE = 20_000
MOST_CENTRES = 2048
#: Balls that a centre is meant for.
HOME = 600
SHARD_NODES = 4096
#: Second centres of a shard for each `shard_nodes` nodes, sampled nodes for each of them, and rows of a slice.
SUB_CENTRES, SUB_SAMPLE, SLICE = 7, 10, 20_000
TILE = 2048
#: Balls that are audited at first and at most, and true pairs that tell the recall.
AUDITED, MOST_AUDITED, ENOUGH_PAIRS = 256, 4096, 200
TARGET = 0.99
_SLACK = 1e-9


def vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat doubles, offsets, usable): whether a row has a direction."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    n = len(offsets) - 1
    usable = np.asarray(column.is_valid()) & (np.diff(offsets) > 0)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    usable &= bad[offsets[1:]] == bad[offsets[:-1]]
    for r in np.flatnonzero(usable):
        if not flat[offsets[r] : offsets[r + 1]].any():
            usable[r] = False
    return flat, offsets[: n + 1], usable


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def balls(x: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ball of each row, centres, radii as angles); all members are within `half` of the centre."""
    n = len(x)
    ball = np.full(n, -1)
    low = x.astype(np.float32)
    close = np.zeros(n, bool)
    bound = math.cos(half)
    for a in range(0, n, 1024):
        s = low[a : a + 1024] @ low.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -1
        close[a : a + 1024] = s.max(axis=1) >= bound
    centres, radii = [], []
    for i in np.flatnonzero(close):
        if ball[i] >= 0:
            continue
        own = np.flatnonzero((ball < 0) & close)
        own = own[low[own] @ low[i] >= bound]
        if len(own) < 2:
            continue
        centre = x[own].mean(axis=0)
        norm = math.sqrt(float(centre @ centre))
        if norm < 1e-6:
            continue
        centre /= norm
        angle = np.arccos(np.clip(x[own] @ centre, -1, 1))
        own, angle = own[angle <= half], angle[angle <= half]
        if len(own) < 2:
            continue
        ball[own] = len(centres)
        centres.append(centre)
        radii.append(float(angle.max()) + _SLACK)
    alone = np.flatnonzero(ball < 0)
    ball[alone] = len(centres) + np.arange(len(alone))
    return ball, np.concatenate((np.array(centres).reshape(-1, x.shape[1]), x[alone])), np.concatenate((np.array(radii), np.zeros(len(alone))))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def robust_prune(x: np.ndarray, degree: int = 20, pool: int = 64, alpha: float = 1.2) -> np.ndarray:
    """Neighbours of each row of unit vectors (-1 where there are fewer), pruned against those already taken."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1)
    if pool < 1:
        return out
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        sim = np.take_along_axis(s, near, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, axis=1), np.take_along_axis(sim, order, axis=1)
        live = np.ones(near.shape, bool)
        rows = np.arange(len(near))
        for d in range(degree):
            pick = live.argmax(axis=1)
            some = live[rows, pick]
            if not some.any():
                break
            chosen = near[rows, pick]
            out[a : a + len(near), d] = np.where(some, chosen, -1)
            between = np.einsum("nkd,nd->nk", x[near], x[chosen])
            live &= ~(alpha * (1 - between) <= 1 - sim)
            live[rows, pick] = False
    return out


def search(x: np.ndarray, reach: np.ndarray, graph: np.ndarray, q: np.ndarray, q_reach: np.ndarray, own: np.ndarray, angle: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) within angle + both radii. graph: neighbours, -1 for none; own: the query's node or -1."""
    n, medoid = len(x), int((x @ x.mean(axis=0)).argmax())
    low = x.astype(np.float32)
    out_q, out_n = [], []
    for a in range(0, len(q), 1024):
        asks, mine = q[a : a + 1024].astype(np.float32), own[a : a + 1024]
        m = len(asks)
        rows = np.arange(m)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1)
        sims = np.full((m, beam), -2, np.float32)
        done = np.zeros((m, beam), bool)
        ids[:, 0] = medoid
        seen[:, medoid] = True
        at = np.flatnonzero((mine >= 0) & (mine != medoid))
        if beam > 1:
            ids[at, 1] = mine[at]
            seen[at, mine[at]] = True
        sims[:, :2] = np.where(ids[:, :2] >= 0, np.einsum("mkd,md->mk", low[ids[:, :2]], asks), -2)
        found_q, found_n = [rows, at], [np.full(m, medoid), mine[at]]
        limit = angle + q_reach[a : a + 1024] + (float(reach.max()) if n else 0)
        in_range = np.cos(np.minimum(limit, math.pi)).astype(np.float32) - np.float32(1e-4)
        while True:
            open_ = np.where(done | (ids < 0), np.float32(-3), sims)
            pick = open_.argmax(axis=1)
            live = np.flatnonzero(open_[rows, pick] > -2)
            if not len(live):
                break
            node = ids[live, pick[live]]
            done[live, pick[live]] = True
            next_ = graph[node]
            fresh = (next_ >= 0) & ~seen[live[:, None], np.maximum(next_, 0)]
            near = np.where(fresh, np.einsum("mkd,md->mk", low[np.maximum(next_, 0)], asks[live]), np.float32(-2))
            r, c = np.nonzero(fresh)
            seen[live[r], next_[r, c]] = True
            hit = near[r, c] >= in_range[live[r]]
            found_q.append(live[r[hit]])
            found_n.append(next_[r[hit], c[hit]])
            all_ids = np.concatenate((ids[live], np.where(fresh, next_, -1)), axis=1)
            all_sims = np.concatenate((sims[live], near), axis=1)
            all_done = np.concatenate((done[live], np.zeros(near.shape, bool)), axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1), np.take_along_axis(all_done, best, 1)
        front_q, front_n = np.concatenate(found_q), np.concatenate(found_n)
        keep = np.einsum("kd,kd->k", low[front_n], asks[front_q]) >= in_range[front_q]
        front_q, front_n = front_q[keep], front_n[keep]
        while len(front_q):  # expand all that is in range
            out_q.append(front_q + a)
            out_n.append(front_n)
            next_ = graph[front_n]
            r, c = np.nonzero((next_ >= 0) & ~seen[front_q[:, None], np.maximum(next_, 0)])
            pairs = np.unique(front_q[r] * n + next_[r, c])
            front_q, front_n = pairs // n, pairs % n
            seen[front_q, front_n] = True
            keep = np.einsum("kd,kd->k", low[front_n], asks[front_q]) >= in_range[front_q]
            front_q, front_n = front_q[keep], front_n[keep]
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    qi, ni = np.concatenate(out_q), np.concatenate(out_n)
    theta = angles(q, x, qi, ni)
    keep = theta <= angle + q_reach[qi] + reach[ni] + _SLACK
    return qi[keep], ni[keep]


def angles(q: np.ndarray, x: np.ndarray, qi: np.ndarray, ni: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi))
    for a in range(0, len(qi), 65_536):
        out[a : a + 65_536] = np.arccos(np.clip((q[qi[a : a + 65_536]] * x[ni[a : a + 65_536]]).sum(axis=1), -1, 1))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)) if len(x) else pa.array([0], pa.int32()), pa.array(x.ravel()))


def to_balls(rows: DataFrame, angle: float) -> DataFrame:
    """(_r, _k, label, dim, lid, v, centre, radius, size): each usable vector, with the ball's data at its first member."""
    kind, label = rows.schema["_k"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        for batch in batches:
            flat, offsets, usable = vectors(batch.column(3))
            labels = batch.column(2)
            usable &= np.asarray(labels.is_valid())
            codes = np.asarray(labels.dictionary_encode().indices.fill_null(-1))
            size = np.diff(offsets)
            for code, dim in sorted({*zip(codes[usable].tolist(), size[usable].tolist(), strict=True)}):
                own = np.flatnonzero(usable & (codes == code) & (size == dim))
                x = unit(flat[(offsets[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim))
                ball, centres, radii = balls(x, angle / 2)
                order = np.argsort(ball, kind="stable")
                own, x, ball = own[order], x[order], ball[order]
                head = np.concatenate(([True], ball[1:] != ball[:-1]))
                count = np.bincount(ball)
                pick = pa.array(own)
                shape = np.where(head, dim, 0)
                starts = np.concatenate(([0], np.cumsum(shape))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pick), batch.column(1).take(pick), labels.take(pick), pa.array(np.full(len(own), dim, np.int32)), pa.array(base + ball),
                    _lists(x), pa.ListArray.from_arrays(pa.array(starts), pa.array(centres[ball[head]].ravel())), pa.array(np.where(head, radii[ball], 0.0)), pa.array(np.where(head, count[ball], 0)),
                ], names=["_r", "_k", "label", "dim", "lid", "v", "centre", "radius", "size"])
                base += len(count)

    return in_arrow(rows, run, f"_r long, _k {kind}, label {label}, dim int, lid long, v array<double>, centre array<double>, radius double, size long")


def fit_centres(leaders: DataFrame, sample: int, most: int) -> dict[tuple, np.ndarray]:
    """Centres of each (label, dim) from a bounded sample; their number follows the number of balls, `most` in all."""
    counts = {(r["label"], r["dim"]): r["n"] for r in leaders.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    slots = 1 << 30
    bound = min(slots, 1 + int(slots * sample / total))
    found: dict[tuple, list] = {}
    for r in leaders.where(F.pmod(F.xxhash64("lid"), F.lit(slots)) < bound).select("label", "dim", "lid", "centre").collect():
        found.setdefault((r["label"], r["dim"]), []).append((r["lid"], r["centre"]))
    rng, out = np.random.default_rng(3), {}
    for key, rows in sorted(found.items(), key=lambda kv: str(kv[0])):
        x = np.array([v for _, v in sorted(rows)])
        k = max(1, min(len(x), math.ceil(counts[key] / HOME), max(1, most * counts[key] // total)))
        out[key] = kmeans(x, k, rng)
    return out


def split_large(rows: DataFrame, overlap: int, probes: int, most: int, shard_nodes: int) -> DataFrame:
    """rows with `d`: 0 in shards of up to `shard_nodes` nodes, else the nearest of the shard's own centres, once for each of them."""
    cell, kept = ["label", "dim", "c"], rows.columns
    size = rows.groupBy(*cell).agg(F.count_if("node").alias("n"), F.count("*").alias("all")).where(F.col("n") > shard_nodes)
    large = staged(size.withColumns({"k": F.least(F.lit(most), F.ceil(F.col("n") * SUB_CENTRES / shard_nodes)).cast("int"), "slices": F.ceil(F.col("all") / SLICE).cast("int")}))  # a row for each centre, of which there are few
    if large.isEmpty():
        return rows.withColumn("d", F.lit(0))
    held = rows.join(F.broadcast(large), cell)
    slots = 1 << 30
    sampled = held.where("node").where(F.pmod(F.xxhash64("lid", F.lit(11)), F.lit(slots)) < F.col("k") * SUB_SAMPLE / F.col("n") * slots)

    def fit(t: pa.Table) -> pa.Table:
        x = _matrix(t["centre"])[np.argsort(np.asarray(t["lid"]))]
        found = kmeans(x, min(len(x), t["k"][0].as_py()), np.random.default_rng(4))
        return pa.table({**{c: t[c].slice(0, 1) for c in cell}, "slices": t["slices"].slice(0, 1), "model": pa.array([found.ravel()], pa.list_(pa.float64()))})

    label = rows.schema["label"].dataType.simpleString()
    models = sampled.groupBy(*cell).applyInArrow(fit, f"label {label}, dim int, c int, slices int, model array<double>")
    models = models.select(*cell, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "model")
    sliced = held.withColumn("slice", F.pmod(F.xxhash64("lid", F.lit(12)), F.col("slices").cast("long")).cast("int")).select(*kept, "slice")

    out = StructType([*rows.schema.fields, StructField("d", IntegerType())])
    none = to_arrow_schema(out).empty_table()

    def deal(t: pa.Table, model: pa.Table) -> pa.Table:
        if not len(t):  # a slice that the hash left empty
            return none
        x, node, n = _matrix(t["centre"]), np.asarray(t["node"]), len(t)
        known = np.asarray(model["model"].combine_chunks().flatten()).reshape(-1, x.shape[1]) if len(model) else np.eye(1, x.shape[1])
        p = min(max((probes + 1) // 2, overlap), len(known))
        near = np.empty((n, p), np.int32)
        for a in range(0, n, 1024):
            near[a : a + 1024] = np.argsort(-(x[a : a + 1024] @ known.T), axis=1, kind="stable")[:, :p]
        take = pa.array(np.repeat(np.arange(n), p))
        own = np.repeat(node, p) & np.tile(np.arange(p) < overlap, n)
        return pa.table({**{c: t[c].take(take) for c in kept if c != "node"}, "node": pa.array(own), "d": pa.array(near.ravel())}).select([*kept, "d"])

    dealt = sliced.groupBy(*cell, "slice").cogroup(models.groupBy(*cell, "slice")).applyInArrow(deal, out)
    return staged(rows.join(F.broadcast(large), cell, "left_anti").withColumn("d", F.lit(0)).unionByName(dealt))


def near_pairs(leaders: DataFrame, centres: dict, angle: float, overlap: int, probes: int, beam: int, shard_nodes: int = SHARD_NODES, most: int = MOST_CENTRES) -> DataFrame:
    """Pairs (a, b) of balls, a below b, that the graph search finds within reach, with theta and both radii and sizes."""
    spark = leaders.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    label = leaders.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key in sorted(set(zip(labels, dims, strict=True)), key=str):
                own = np.array([i for i, k in enumerate(zip(labels, dims, strict=True)) if k == key])
                known = shared.value.get(key)
                x = _matrix(batch.column(3).take(pa.array(own)))
                if known is None:  # too rare for the sample
                    known = np.eye(1, key[1])
                p = min(probes, len(known))
                s = x @ known.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :p]
                rows = pa.array(np.repeat(own, p))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).take(rows) for i in range(6)], pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(p) < overlap, len(own))),
                ], names=["label", "dim", "lid", "centre", "radius", "size", "c", "node"])

    shape = f"label {label}, dim int, lid long, centre array<double>, radius double, size long, c int, node boolean"
    rows = staged(in_arrow(leaders.select("label", "dim", "lid", "centre", "radius", "size"), assign, shape))
    rows = split_large(rows, overlap, probes, most, shard_nodes)
    shard = ["label", "dim", "c", "d"]
    parts = rows.where("node").groupBy(*shard).agg(F.ceil(F.count("*") / shard_nodes).cast("int").alias("parts"))  # a row for each shard
    rows = rows.join(parts, shard)
    part = F.pmod(F.xxhash64("lid", F.lit(5)), F.col("parts").cast("long")).cast("int")
    nodes = rows.where("node").select(*rows.columns, part.alias("part"))
    asks = rows.where(~F.col("node") | (F.col("parts") > 1)).select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where(~F.col("node") | (F.col("part") != part)).withColumn("node", F.lit(False))

    def build(t: pa.Table) -> pa.Table:
        graph, ids = robust_prune(_matrix(t["centre"])), np.asarray(t["lid"])
        keep = graph >= 0
        ends = np.concatenate(([0], np.cumsum(keep.sum(axis=1)))).astype(np.int32)
        return pa.table({"lid": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[graph[keep]]))})

    lists = nodes.groupBy(*shard, "part").applyInArrow(build, "lid long, near array<long>")
    united = lists.groupBy("lid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list for each shard of a node
    members = nodes.join(united, "lid").unionByName(asks, allowMissingColumns=True)

    def look(t: pa.Table) -> pa.Table:
        node = np.asarray(t["node"])
        ids, x, reach, size = np.asarray(t["lid"]), _matrix(t["centre"]), np.asarray(t["radius"]), np.asarray(t["size"])
        own = np.flatnonzero(node)
        none = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "theta": pa.array([], pa.float64()), "ra": pa.array([], pa.float64()), "rb": pa.array([], pa.float64()), "na": pa.array([], pa.int64()), "nb": pa.array([], pa.int64())}
        if len(own):
            order = own[np.argsort(ids[own])]
            sorted_ids = ids[order]
            near = t["near"].combine_chunks()
            near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
            near = near.take(pa.array(order))
            flat, width = np.asarray(near.flatten()), np.asarray(near.value_lengths().fill_null(0))
            graph = np.full((len(order), max(int(width.max()), 1)), -1)
            spot = np.minimum(np.searchsorted(sorted_ids, flat), len(order) - 1)
            graph[np.arange(graph.shape[1])[None, :] < width[:, None]] = np.where(sorted_ids[spot] == flat, spot, -1)
            place = np.minimum(np.searchsorted(sorted_ids, ids), len(order) - 1)
            mine = np.where(sorted_ids[place] == ids, place, -1)
            qi, ni = search(x[order], reach[order], graph, x, reach, mine, angle, beam)
            ni = order[ni]
            keep = ids[qi] != ids[ni]
            qi, ni = qi[keep], ni[keep]
            swap = ids[qi] > ids[ni]
            a, b = np.where(swap, ni, qi), np.where(swap, qi, ni)
            pairs, first = np.unique(np.stack((ids[a], ids[b])), axis=1, return_index=True) if len(a) else (None, np.empty(0, np.int64))
            a, b = a[first], b[first]
            theta = angles(x, x, a, b)
            none = {"a": pa.array(ids[a]), "b": pa.array(ids[b]), "theta": pa.array(theta), "ra": pa.array(reach[a]), "rb": pa.array(reach[b]), "na": pa.array(size[a]), "nb": pa.array(size[b])}
        return pa.table(none)

    found = members.groupBy(*shard, "part").applyInArrow(look, "a long, b long, theta double, ra double, rb double, na long, nb long")
    return staged(found.dropDuplicates(["a", "b"]))


def audit(leaders: DataFrame, pairs: DataFrame, angle: float, audited: int, n: int) -> tuple[int, int]:
    """Of the pairs of a sample of the n balls, found by brute force over all balls, how many the search has found too, and how many there are."""
    slots = 1 << 30
    rows = leaders.where(F.pmod(F.xxhash64("lid", F.lit(9)), F.lit(slots)) < min(slots, 1 + int(slots * audited / max(n, 1)))).select("label", "dim", "lid", "centre", "radius").collect()
    if not rows:
        return 0, 0
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault((r["label"], r["dim"]), []).append(r)
    sample = {k: (np.array([r["lid"] for r in v]), np.array([r["centre"] for r in v]), np.array([r["radius"] for r in v])) for k, v in groups.items()}
    shared = leaders.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key in set(keys) & set(shared.value):
                own = pa.array([i for i, k in enumerate(keys) if k == key])
                ids, x, reach = np.asarray(batch.column(2).take(own)), _matrix(batch.column(3).take(own)), np.asarray(batch.column(4).take(own))
                lid, centre, radius = shared.value[key]
                theta = np.arccos(np.clip(centre @ x.T, -1, 1))
                i, j = np.nonzero((theta <= angle + radius[:, None] + reach[None, :] - 1e-7) & (lid[:, None] != ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(lid[i], ids[j])), pa.array(np.maximum(lid[i], ids[j]))], names=["a", "b"])

    true = in_arrow(leaders.select("label", "dim", "lid", "centre", "radius"), run, "a long, b long").distinct()
    seen = true.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return seen["hit"], seen["n"]


def verify(rows: DataFrame, doubtful: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact links between the members of pairs of balls: (row, n) counts, and the pairs that have a link. In tiles."""
    tiles = doubtful.select("a", "b", F.ceil(F.col("na") / TILE).cast("int").alias("ta"), F.ceil(F.col("nb") / TILE).cast("int").alias("tb"))
    own = rows.select(F.col("lid"), "_r", "v")
    salt = lambda t: F.pmod(F.xxhash64("_r"), F.col(t).cast("long")).cast("int")
    left = tiles.join(own, tiles["a"] == own["lid"]).select("a", "b", salt("ta").alias("i"), F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("j"), F.lit(True).alias("side"), "_r", "v")
    right = tiles.join(own, tiles["b"] == own["lid"]).select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ta") - 1)).alias("i"), salt("tb").alias("j"), F.lit(False).alias("side"), "_r", "v")

    def count(t: pa.Table) -> pa.Table:
        side, x, r = np.asarray(t["side"]), _matrix(t["v"]), np.asarray(t["_r"])
        hit = x[side] @ x[~side].T >= threshold
        n = np.zeros(len(r), np.int64)
        n[side], n[~side] = hit.sum(axis=1), hit.sum(axis=0)
        keep = n > 0
        one = pa.array([t["a"][0].as_py()] * int(keep.sum()), pa.int64()), pa.array([t["b"][0].as_py()] * int(keep.sum()), pa.int64())
        return pa.table({"_r": pa.array(r[keep]), "n": pa.array(n[keep]), "a": one[0], "b": one[1]})

    found = staged(left.union(right).groupBy("a", "b", "i", "j").applyInArrow(count, "_r long, n long, a long, b long"))
    return found.groupBy("_r").agg(F.sum("n").alias("n")), found.select("a", "b").distinct()


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, most_centres: int = MOST_CENTRES, target: float = TARGET, most_audited: int = MOST_AUDITED, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row for each row of df: key, n_links, component_id, kept."""
    angle = math.acos(threshold)
    rows = staged(df.select(F.col(key).alias("_k"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).withColumn("_r", F.monotonically_increasing_id()).select("_r", "_k", "label", "v"))
    balled = staged(to_balls(rows, angle))
    leaders = balled.where("size > 0").select("label", "dim", "lid", "centre", "radius", "size")
    centres = fit_centres(leaders, sample, most_centres)
    most = max((len(c) for c in centres.values()), default=1)
    probes, beam, n = 5, 24, leaders.count()
    most = max(most, 2 * min(most_centres, math.ceil(n * SUB_CENTRES / shard_nodes)))  # asks go to half as many second centres
    while True:
        pairs = near_pairs(leaders, centres, angle, 2, probes, beam, shard_nodes, most_centres)
        audited = AUDITED
        hit, true = audit(leaders, pairs, angle, audited, n)
        while true < ENOUGH_PAIRS and audited < min(n, most_audited):
            audited = min(audited * 4, most_audited)
            hit, true = audit(leaders, pairs, angle, audited, n)
        if hit >= target * true:
            break
        if probes >= most and beam >= 512:
            raise RuntimeError(f"the search finds {hit} of {true} audited pairs, less than {target}")
        dropped(pairs)
        probes, beam = probes * 2, beam * 2
    one = F.greatest("na", "nb") == 1
    whole = pairs.where(F.when(one, F.cos("theta") >= threshold - 1e-12).otherwise(F.col("theta") + F.col("ra") + F.col("rb") <= angle - _SLACK))
    single_edge = one & (F.abs(F.cos("theta") - threshold) < 1e-9)  # so near the threshold that the exact product decides
    doubtful = pairs.where(F.when(one, single_edge).otherwise(F.col("theta") + F.col("ra") + F.col("rb") > angle - _SLACK))
    whole = whole.where(~single_edge)
    exact, linked = verify(balled, doubtful, threshold)
    both = whole.select(F.col("a").alias("lid"), F.col("nb").alias("n")).union(whole.select("b", "na"))
    degree = both.groupBy("lid").agg(F.sum("n").alias("around"))
    roots = components(whole.select("a", "b").union(linked), "a", "b")
    members = balled.select("_r", "_k", "lid")
    per_ball = balled.groupBy("lid").agg(F.min("_k").alias("low"), F.max("size").alias("size"))
    named = per_ball.join(roots, per_ball["lid"] == roots["node"], "left").select("lid", F.col("lid").alias("node"), "low", "size", F.coalesce("root", "lid").alias("root"))
    named = named.join(degree, "lid", "left")
    named = with_smallest(named, "low", "component_id").select("lid", "component_id", (F.col("size") - 1 + F.coalesce("around", F.lit(0))).alias("base"))
    linked_rows = members.join(named, "lid").join(exact, "_r", "left").select("_r", "component_id", (F.col("base") + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("_r", "_k").join(linked_rows, "_r", "left")
    found = F.when(F.col("n_links").isNull(), F.col("_k")).otherwise(F.col("component_id"))
    return out.select(F.col("_k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), found.alias("component_id"), F.col("_k").eqNullSafe(found).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
