"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. Groups become items with a size in each dimension, and each item goes to the shard where
the dot product of its size with the residual capacity (both as shares of the capacity) is highest among the shards
with room, largest items first. A plan for all groups would grow with the input, so groups that are small (a fair share
of `bundles_a_shard` bundles of a shard at most) are joined into bundles by a hash of the text; each larger one is an item of its own.
A group stays whole as long as it fits into some shard. One that fits into none is cut by rows: a group larger than a
shard is dealt out after all others, another is poured into as few shards as have room. Rows of a large group are numbered
in pieces of a bundle's size, told apart by a hash of the row's number, so neither equal rows nor equal keys meet in
one task. At most a few times `bundles_a_shard` items a shard reach the driver, whatever the input.

A last pass over the plan moves or swaps items between the fullest and the emptiest shard while that brings their
bytes closer. Slots are a piece's offset in its shard plus the row's place in the piece, so numbering a shard needs
no task that sees all of it.

Law of the query: `bytes`. Defined results: a null text has no bytes and size 1, as the empty one, and is in one group with it;
null keys come first within a piece; repeated rows get slots of their own; ties go to the first shard. An empty table gives an empty
result. Columns other than key and text are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, staged, table

#: Items that small groups are joined into, for each shard.
BUNDLES_A_SHARD = 256
DIMENSIONS = ("bytes", "tokens", "rows")
#: Of the fullest and of the emptiest shard, so many of the smallest items are looked at for a move or a swap.
SWAPPED = 256


def pack(sizes: np.ndarray, shards: int, group: np.ndarray | None = None) -> np.ndarray:
    """Shard of each piece; sizes has a row for each piece and a column for each dimension. Pieces of one group stay
    together where that is possible; by default each is a group of its own."""
    if not len(sizes):
        return np.empty(0, np.int64)
    group = np.arange(len(sizes)) if group is None else np.unique(group, return_inverse=True)[1]
    capacity = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    share = sizes / capacity
    whole = np.zeros((int(group.max()) + 1, sizes.shape[1]))
    np.add.at(whole, group, share)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    residual = np.ones((shards, sizes.shape[1]))
    unit = np.zeros(len(sizes), np.int64)  # what the last pass moves as one
    where: list[int] = []

    def best(item: np.ndarray) -> int | None:
        fits = (residual >= item - 1e-12).all(axis=1)
        return int(np.where(fits, residual @ item, -np.inf).argmax()) if fits.any() else None

    def put(pieces: np.ndarray, s: int) -> None:
        residual[s] -= share[pieces].sum(axis=0)
        unit[pieces] = len(where)
        where.append(s)

    torn = (whole.max(axis=1) > 1) & (np.bincount(group) > 1)  # larger than a shard: dealt out last, as they fill any room
    for g in np.lexsort((np.arange(len(whole)), -whole.max(axis=1), torn)):
        own = members[g]
        s = best(whole[g])
        if s is not None:
            put(own, s)
            continue
        s = None
        for i in own:
            if s is None or torn[g] or (residual[s] < share[i] - 1e-12).any():
                s = best(share[i])
            put(np.array([i]), int(residual[:, 0].argmax()) if s is None else s)
    totals = np.zeros((len(where), sizes.shape[1]))
    np.add.at(totals, unit, sizes)
    return level(totals, np.array(where), shards)[unit]


def level(sizes: np.ndarray, where: np.ndarray, shards: int, rounds: int = 2000) -> np.ndarray:
    """Move or swap items between shards while that brings the fullest and the emptiest closer in the first dimension,
    without bringing another dimension further out than it or the first one is."""
    where, load = where.copy(), np.zeros((shards, sizes.shape[1]))
    np.add.at(load, where, sizes)
    mean = np.maximum(load.mean(axis=0), 1e-9)
    for _ in range(rounds):
        hi, lo = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[hi, 0] - load[lo, 0]
        own, other = (x[np.argsort(sizes[x, 0], kind="stable")[:SWAPPED]] for x in (np.flatnonzero(where == hi), np.flatnonzero(where == lo)))
        if gap <= 0 or not len(own):
            break
        diff = sizes[own][:, None, :] - np.concatenate((np.zeros((1, sizes.shape[1])), sizes[other]))[None, :, :]
        after = np.abs(gap - 2 * diff[:, :, 0])
        far = np.maximum(np.abs(load[hi] - diff - mean), np.abs(load[lo] + diff - mean))[:, :, 1:] / mean[1:]
        most = max(np.abs(load / mean - 1).max(), 1e-4)
        after = np.where((far <= most).all(axis=2), after, np.inf)
        x, y = np.unravel_index(int(after.argmin()), after.shape)
        if not after[x, y] < gap:
            break
        load[hi] -= diff[x, y]
        load[lo] += diff[x, y]
        where[own[x]] = lo
        if y:
            where[other[y - 1]] = hi
    return where


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", bundles_a_shard: int = BUNDLES_A_SHARD) -> DataFrame:
    """One row for each row of df: key, size, tokens, text_crc32, shard, slot."""
    t = F.col(text).cast("string")
    words = F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = staged(df.select(
        F.col(key).alias("_k"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), words.cast("long").alias("tokens"),
        F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h1"), F.xxhash64(F.lit(1), F.coalesce(t, F.lit(""))).alias("h2"),
        F.monotonically_increasing_id().alias("_r"),
    ))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select(F.col("_k").alias(key), "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n = shards * bundles_a_shard
    # A piece holds a bundle's fair share of each dimension at most, but for single rows that are larger.
    limit = {d: max(1, total[d] // n) for d in DIMENSIONS}
    over = F.greatest(*[F.col(d) / limit[d] for d in DIMENSIONS])
    heavy = rows.groupBy("h1", "h2").agg(*sums).where(over > 1).select("h1", "h2", F.least(F.ceil(over), F.col("rows")).cast("int").alias("pieces"))
    # At most n * 3 groups exceed a limit, as each dimension's sizes add up to n limits.
    salted = F.pmod(F.xxhash64("_r", F.lit(11)), F.col("pieces").cast("long"))
    placed = rows.join(F.broadcast(heavy), ["h1", "h2"], "left")
    item = F.when(F.col("pieces").isNull(), F.struct(F.pmod("h1", F.lit(n)).alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(F.struct(F.col("h1").alias("a"), F.col("h2").alias("b"), salted.alias("c")))
    placed = staged(placed.select("_k", "size", "tokens", "text_crc32", "h1", "_r", item.alias("item")))
    dropped(rows)
    items = placed.groupBy("item").agg(*sums).collect()
    items.sort(key=lambda r: (r["item"]["b"] is not None, r["item"]["a"], r["item"]["b"] or 0, r["item"]["c"]))
    groups: dict[tuple, int] = {}
    of = np.array([groups.setdefault((r["item"]["a"], r["item"]["b"]), len(groups)) for r in items])
    where = pack(np.array([[r[d] for d in DIMENSIONS] for r in items], float), shards, of)
    offsets, plan = np.zeros(shards, np.int64), []
    for k, (r, s) in enumerate(zip(items, where.tolist(), strict=True)):
        plan.append((r["item"]["a"], r["item"]["b"], r["item"]["c"], k, s, int(offsets[s])))
        offsets[s] += r["rows"]
    spark = df.sparkSession
    plan = spark.createDataFrame(plan, "a long, b long, c long, n int, shard int, offset long")
    named = placed.join(F.broadcast(plan), (F.col("item.a") == plan["a"]) & F.col("item.b").eqNullSafe(plan["b"]) & (F.col("item.c") == plan["c"]))
    within = Window.partitionBy("n").orderBy(F.col("_k").asc_nulls_first(), "h1", "_r")
    slot = F.col("offset") + F.row_number().over(within) - 1
    return named.select("_k", "size", "tokens", "text_crc32", "shard", "h1", "_r", "n", "offset").withColumn("slot", slot).select(F.col("_k").alias(key), "size", "tokens", "text_crc32", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
