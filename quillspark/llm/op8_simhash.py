"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two of at most `threshold` (4) differing bits are linked. The bits are cut into three
blocks, so linked fingerprints differ in at most one bit of some block. In a block, the anchors are the code words
of the perfect (23, 12) Golay code: every block value lies within the covering radius, 3, of exactly one anchor, its
home. A fingerprint is replicated to every anchor within the radius plus the block's threshold, 4: if x and y differ
in one bit of the block, y reaches x's home. Per anchor, the fingerprints at home are compared with all that reached
it. No link is lost.

Equal texts and equal fingerprints count once. An anchor that many fingerprints reach is cut into tiles, each of a
bounded number at home and a bounded number that reached it; the counts of all anchors fit a table of 12,288 rows.
A tile returns a spanning forest of its links, not all of them, so what a group of copies yields grows with its
size. Components come from repeated contraction.

Near-duplicates of a lower similarity differ in too many of 64 bits to be told from chance. The pipeline's stage
(`one_of_each`) links texts whose sets of five-word shingles have a similarity of 0.8. It takes the fingerprints' candidates
first, finds the pairs that they miss by prefix filtering, which loses none (`similar`), and verifies every candidate by the
exact similarity.

Defined results: a text that is null or has no word has fingerprint zero and is linked like any other; with fewer
words than a shingle, the whole sequence is the shingle. component_id is the smallest key reachable, null if all
keys there are null. Repeated rows all come back.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, dropped, fresh_name, in_arrow, mix64, row_words, small, staged, table, typed, utf8, word_hashes
from .components import components, with_smallest

#: First bit and number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, a fixed value of coding theory: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
RADIUS = 3
#: Most fingerprints at home, and most that reached the anchor, of a tile.
TILE = (1024, 4096)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, words_each: int = 4, prints: int = 1) -> np.ndarray:
    """64-bit fingerprints of whole texts, as signed longs: a row for each text, a column for each print. The first one
    takes the hashes of the shingles, the others remixed ones."""
    out = np.zeros((len(offsets) - 1, prints), np.uint64)
    xxh = xxhash.xxh64_intdigest
    for a, b in blocks(offsets):
        hashes: list[int] = []
        counts = np.zeros(b - a, np.int64)
        for r in range(a, b):
            words = raw[offsets[r] : offsets[r + 1]].tobytes().lower().split()
            if not words:
                continue
            if len(words) <= words_each:
                hashes.append(xxh(b" ".join(words), 42))
                counts[r - a] = 1
                continue
            joined = b" ".join(words)
            ends = list(itertools.accumulate(map(len, words), lambda s, n: s + n + 1))
            hashes += [xxh(joined[s:e], 42) for s, e in zip([0, *[e + 1 for e in ends[:-words_each]]], ends[words_each - 1 :], strict=True)]
            counts[r - a] = len(words) - words_each + 1
        filled = np.flatnonzero(counts)
        if not len(filled):
            continue
        starts = (np.cumsum(counts) - counts)[filled]
        first = np.array(hashes, np.uint64)
        for k in range(prints):
            own = mix64(first + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) if k else first
            bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[a + filled, k] = np.packbits(ones * 2 > counts[filled][:, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def _names(prints: int) -> list[str]:
    return [f"f{k}" for k in range(prints)]


def with_fingerprint(df: DataFrame, words_each: int = 4, prints: int = 1, text: str = "text") -> DataFrame:
    """df with the prints of each text as longs f0, f1 ..., which must be free names."""
    at, names = df.columns.index(text), _names(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, at):
            raw, offsets, _ = utf8(batch.column(at))
            made = fingerprints(raw, offsets, words_each, prints)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(made[:, k]) for k in range(prints)]], names=[*batch.schema.names, *names])

    return in_arrow(df, run, typed(df, *[(n, T.LongType()) for n in names]))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for k in range(22, 10, -1):
        rest ^= ((rest >> k) & 1) * (GOLAY << (k - 11))
    return rest


def error_patterns(most: int) -> list[np.ndarray]:
    """For each syndrome, the error patterns of up to `most` bits; the first one is the lightest."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(most + 1):
        patterns = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(23), weight)], np.int64)
        for p, s in zip(patterns.tolist(), _syndromes(patterns).tolist(), strict=True):
            found[s].append(p)
    return [np.array(x, np.int64) for x in found]


def replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, at home) of every replica. An anchor's number holds its block and its code word."""
    patterns = error_patterns(RADIUS + 1)
    widths = np.array([len(p) for p in patterns])
    firsts, flat = np.cumsum(widths) - widths, np.concatenate(patterns)
    index, anchor, home = [], [], []
    for k, (shift, bits) in enumerate(BLOCKS):
        value = ((prints.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = _syndromes(value)
        n = widths[s]
        who = np.repeat(np.arange(len(prints)), n)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        index.append(who)
        anchor.append((value[who] ^ flat[firsts[s][who] + nth]) | (k << 24))
        home.append(nth == 0)
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes below n that links join to a smaller one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def compare(prints: np.ndarray, node: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between those at home and all, as nodes. prints: a row for each replica."""
    nodes, first, which = np.unique(node, return_index=True, return_inverse=True)
    values = prints[first].view(np.uint64)
    all_nodes, home_nodes = np.unique(which[~home]), np.unique(which[home])
    left, right = [], []
    for i in range(0, len(home_nodes), 128):
        own = home_nodes[i : i + 128]
        apart = np.bitwise_count(values[own, 0][:, None] ^ values[all_nodes, 0][None, :]).astype(np.uint16)
        for k in range(1, values.shape[1]):
            apart += np.bitwise_count(values[own, k][:, None] ^ values[all_nodes, k][None, :])
        x, y = np.nonzero(apart <= threshold)
        keep = own[x] != all_nodes[y]
        left.append(own[x[keep]])
        right.append(all_nodes[y[keep]])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, root = forest(np.concatenate(left), np.concatenate(right), len(nodes))
    return nodes[at], nodes[root]


def replicated(distinct: DataFrame, prints: int = 1) -> DataFrame:
    """A staged row for each anchor that a node with the prints f0, f1 ... (each node once) reaches: anchor, home, node, prints."""
    names = _names(prints)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                for k in range(prints):
                    index, anchor, home = replicas(np.asarray(part.column(1 + k)))
                    rows = pa.array(index)
                    yield pa.RecordBatch.from_arrays([pa.array((anchor + k * (len(BLOCKS) << 24)).astype(np.int32)), pa.array(home), *[c.take(rows) for c in part.columns]], names=["anchor", "home", "node", *names])

    shape = ", ".join(f"{n} long" for n in ["node", *names])
    return staged(in_arrow(distinct.select("node", *names), spread, f"anchor int, home boolean, {shape}"))


def links(rows: DataFrame, threshold: int = 4, prints: int = 1) -> DataFrame:
    """Links (a, b) between replicated nodes that join those of at most `threshold` differing bits in all, and no others.
    With one print and a threshold up to 5 none is missed; otherwise those that differ in more than one bit of every
    block are."""
    names = _names(prints)
    sizes = rows.groupBy("anchor").agg(F.ceil(F.count_if("home") / TILE[0]).cast("int").alias("nh"), F.ceil(F.count("*") / TILE[1]).cast("int").alias("nr"))
    sizes = sizes.where("nh > 0")  # anchors are at most 3 * 4096 for each print, whatever the input
    salt = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20))
    tiled = rows.join(F.broadcast(sizes), "anchor")
    at_home = tiled.where("home").select("anchor", (salt % F.col("nh")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), "home", "node", *names)
    reached = tiled.select("anchor", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("i"), (salt % F.col("nr")).cast("int").alias("j"), F.lit(False).alias("home"), "node", *names)

    def tile(t: pa.Table) -> pa.Table:
        a, b = compare(np.stack([np.asarray(t[n]) for n in names], axis=1), np.asarray(t["node"]), np.asarray(t["home"]), threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return at_home.union(reached).groupBy("anchor", "i", "j").applyInArrow(tile, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 4, threshold: int = 4, prints: int = 1) -> DataFrame:
    """One row (key, h1, h2, f0 ..., component_id) for each row of df; h1 and h2 name the text."""
    own = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    names = _names(prints)
    made = with_fingerprint(own, words_each, prints, "_t").select("_k", F.xxhash64("_t").alias("h1"), F.xxhash64(F.lit(1), "_t").alias("h2"), *names, (F.col("f0") if prints == 1 else F.xxhash64(*names)).alias("node"))
    rows = staged(made)
    groups = staged(rows.groupBy("node").agg(F.min("_k").alias("low"), *[F.any_value(n).alias(n) for n in names]))
    replicas = replicated(groups, prints)
    roots = components(links(replicas, threshold, prints))
    dropped(replicas)
    rooted = groups.join(roots.withColumnRenamed("node", "at"), groups["node"] == F.col("at"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    named = with_smallest(rooted, "low", "component_id").select("node", "root", "component_id")
    return rows.join(named, "node").select(F.col("_k").alias(key), "h1", "h2", *names, "root", "component_id")


#: The pipeline's rule: texts whose sets of shingles of so many words have a Jaccard similarity of OVER / UNDER at least.
NEAR_WORDS = 5
OVER, UNDER = 4, 5
#: About so many texts are sampled for the order of shingles, and at most so many shingles are known as frequent.
ORDER_SAMPLE = 20_000
ORDER_SHINGLES = 200_000
#: Shingles in so large a share of the sampled texts are dealt over so many tasks.
HOT_SHARE, SALTS = 0.01, 32
#: Sets that a task compares with one.
COMPARED = 64
#: Bits of a set's mark, and bits that say which nodes a pass over the texts is for.
MARK_BITS = 1024
WANTED_BITS = 1 << 26
_U = np.uint64


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words_each: int = NEAR_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, sizes, shingles) of the rows a to b, a block at a time: each row's distinct shingle hashes in ascending order.
    A text of fewer words than a shingle is one shingle, one without a word has none."""
    for a, b in blocks(offsets):
        lo = int(offsets[a])
        own = raw[lo : int(offsets[b])].copy()
        own[(own >= 65) & (own <= 90)] += 32
        starts, ends, rows = row_words(own, offsets[a : b + 1] - lo, 0, b - a)
        hashes = word_hashes(own, starts, ends)
        n = len(hashes)
        total, live = np.zeros(n, np.uint64), np.ones(n, bool)
        first = np.searchsorted(rows, np.arange(b - a))
        count = np.bincount(rows, minlength=b - a)
        short = (count < words_each)[rows] if n else live
        for k in range(words_each):
            at = np.arange(n) + k
            inside = at < (first + count)[rows] if n else live
            live &= inside | short
            word = np.where(inside, hashes[np.minimum(at, max(n - 1, 0))], _U(k + 1))
            total = mix64(total * _U(0x9E3779B97F4A7C15) + word)
        live &= ~short | (np.arange(n) == first[rows])
        rows, total = rows[live], total[live]
        order = np.lexsort((total, rows))
        rows, total = rows[order], total[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (total[1:] != total[:-1])
        rows, total = rows[fresh], total[fresh]
        yield a, b, np.bincount(rows, minlength=b - a), total


def set_prints(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Fingerprints, as signed longs, of sets of so many hashes each: a bit is 1 if it is in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[filled], axis=0, dtype=np.int32)
        out[filled] = np.packbits(ones * 2 > sizes[filled][:, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def _with_sets(df: DataFrame, text: str, what: str, frequent: tuple[np.ndarray, np.ndarray] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """df with the text replaced by `node`, the hash of its shingle set, `n`, the set's size, and, as `what` says, the whole
    `set`, the `prefix`: the n - ceil(n * OVER / UNDER) + 1 shingles that come first in the order of (frequency, hash), or the `mark`: for each bit of it, whether an odd number of shingles fall on it, with the
    set's fingerprint as `f0`.
    Sets and prefixes come once for each node and task; wanted: rows of other nodes may go."""
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast((frequent, wanted))
    rest = [f for f in df.schema.fields if f.name != text]
    shape = T.StructType([*rest, *[T.StructField(c, T.LongType()) for c in ("node", "n", "f0")], T.StructField(what, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value[0] if shared.value[0] is not None else (np.empty(0, np.uint64), np.empty(0, np.int64))
        chosen, done = shared.value[1], set()
        for batch in small(batches, at):
            raw, offsets, _ = utf8(batch.column(at))
            for a, b, sizes, flat in shingle_sets(raw, offsets):
                rows = np.repeat(np.arange(b - a), sizes)
                node = np.zeros(b - a, np.uint64)
                np.add.at(node, rows, mix64(flat ^ _U(0x5851F42D4C957F2D)))
                node = mix64(node + sizes.astype(np.uint64))
                part, prints = batch.slice(a, b - a), np.zeros(b - a, np.int64)
                if what != "mark":
                    stay = np.zeros(len(node), bool)
                    if chosen is not None:
                        stay |= ((chosen[(node & _U(WANTED_BITS - 1)).astype(np.int64) >> 3] >> (node & _U(7)).astype(np.uint8)) & 1) == 0
                    for i in np.flatnonzero(~stay).tolist():
                        stay[i] = (v := int(node[i])) in done
                        done.add(v)
                    stay = ~stay
                    part, flat, node, sizes, prints = part.filter(pa.array(stay)), flat[stay[rows]], node[stay], sizes[stay], prints[stay]
                    rows = np.repeat(np.arange(len(sizes)), sizes)
                kept = sizes
                if what == "mark":
                    mark, begin = np.zeros((len(sizes), MARK_BITS // 8), np.uint8), np.concatenate(([0], np.cumsum(sizes)))
                    for i in range(0, len(sizes), 1024):  # a block may hold very many short texts
                        j = min(i + 1024, len(sizes))
                        own = slice(begin[i], begin[j])
                        bits = np.bincount((rows[own] - i) * MARK_BITS + (flat[own] & _U(MARK_BITS - 1)).astype(np.int64), minlength=(j - i) * MARK_BITS)
                        mark[i:j] = np.packbits((bits & 1).astype(np.uint8).reshape(j - i, MARK_BITS), axis=1)
                    prints = set_prints(sizes, flat)
                    flat, kept = mark.view(np.uint64).ravel(), np.full(len(sizes), MARK_BITS // 64)
                if what == "prefix":
                    common = np.zeros(len(flat), np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                        common = np.where(known[place] == flat, seen[place], 0)
                    kept = np.where(sizes > 0, sizes + (-OVER * sizes // UNDER) + 1, 0)
                    order = np.lexsort((flat, common, rows))
                    nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    flat = flat[order][nth < np.repeat(kept, sizes)]
                columns = [c for k, c in enumerate(part.columns) if k != at]
                columns += [pa.array(node.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(prints)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32)), pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return in_arrow(df, run, shape)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingle, texts) of the most frequent shingles of a sample, in ascending order of the shingle, and the sample's number
    of texts. Any order of shingles gives the same links; this one keeps shingles of many texts out of the prefixes."""
    nodes = rows.count()
    step = max(1, nodes // ORDER_SAMPLE)
    some = _with_sets(rows.where(F.pmod(F.xxhash64("_t", F.lit(3)), F.lit(step)) == 0).select("_t").distinct(), "_t", "set").dropDuplicates(["node"])
    top = some.select(F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "x").limit(ORDER_SHINGLES).toArrow()
    known = np.asarray(top["x"]).astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.asarray(top["c"]).astype(np.int64)[order], max(1, nodes // step)


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A table of WANTED_BITS bits, of fixed size, with those of the nodes set."""
    place = nodes.select(F.col("node").bitwiseAND(F.lit(WANTED_BITS - 1)).alias("p"))
    maps = place.groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("m")).collect()
    out = np.zeros((WANTED_BITS >> 15, 4096), np.uint8)
    for r in maps:
        out[r["k"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out.ravel()


def _compared(t: pa.Table) -> pa.Table:
    """(a, b) of the rows b whose sets have the similarity with that of the row a. A node may come more than once."""
    a, node, sets = t["a"][0].as_py(), t["node"].to_numpy(), t["set"].combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    flat, ends = np.asarray(sets.flatten()), np.concatenate(([0], np.cumsum(np.asarray(sets.value_lengths()))))
    nodes, first = np.unique(node, return_index=True)
    of = lambda i: flat[ends[i] : ends[i + 1]]
    own = of(int(first[np.searchsorted(nodes, a)]))
    near = []
    for b, i in zip(nodes.tolist(), first.tolist(), strict=True):
        other = of(i)
        if b != a and len(np.intersect1d(own, other, assume_unique=True)) * (OVER + UNDER) >= (len(own) + len(other)) * OVER:
            near.append(b)
    return pa.table({"a": pa.array([a] * len(near), pa.int64()), "b": pa.array(near, pa.int64())})


def _attached(pairs: DataFrame, own: DataFrame, node: str, other: str) -> DataFrame:
    """pairs with the columns that own has for the node. A node of very many pairs is looked up by `SALTS` tasks."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    each = salted.select(node, "_salt").distinct().join(own, node)
    return salted.join(each, [node, "_salt"]).drop("_salt")


def similar(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of the texts `_t` whose components are those of all pairs of shingle sets with a
    similarity of OVER / UNDER at least; every link is such a pair. marks: (node, n, f0, mark), a row for each node.

    Candidates come from the fingerprints f0, by anchor-point covering. They bring the nearest copies together, but
    two sets of similarity 0.8 differ in some 10 of 64 bits, too many to look for. So the others come from the sets
    themselves. The shared part of two such sets makes up OVER / (OVER + UNDER) of both sizes together at least. So they share a
    shingle of their prefixes in any common order. What stands before the first shared one counts for nothing, so from the rest
    follows up to which size, `most`, a set can meet others by a shingle. No pair is lost by that.

    Of the sets under a shingle that have the most frequent size there, the one that shares most of its prefix (in a group of
    near copies, the text they come from) is compared with the others, along with the fingerprints' candidates. Then pairs that are not joined yet are
    compared, by size: the larger set asks those of the sizes that it can meet. So a group of near copies needs no square of its
    size. Shingles that a sample finds in many texts are dealt by a salt where rows of a shingle are compared in place.

    Bits in which two marks differ are shingles in which the sets differ, so marks rule out candidates; the rest is
    verified on whole sets.
    """
    meets = lambda a, b: (F.least(a["n"], b["n"]) * UNDER >= F.greatest(a["n"], b["n"]) * OVER) & (a["n"] <= b["most"]) & (b["n"] <= a["most"]) & ((a["n"] <= b["tight"]) | (b["n"] <= a["tight"]))

    def verified(pairs: DataFrame) -> DataFrame:
        own = lambda k: marks.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("mark").alias(f"m{k}"))
        apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = _attached(_attached(pairs.distinct(), own("a"), "a", "b"), own("b"), "b", "a")
        left = staged(both.where(apart * (OVER + UNDER) <= (F.col("na") + F.col("nb")) * (UNDER - OVER)).select("a", "b"))
        # Each set goes to the tasks of its pairs: those of `a`, by a salt if there are very many.
        many = staged(left.groupBy("a").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias("tasks")).where("tasks > 1"))
        dealt = left.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("tasks", F.lit(1)).cast("long")).cast("int").alias("t"))
        wanted = staged(dealt.select("a", "t", F.col("b").alias("node")).union(dealt.select("a", "t", F.col("a").alias("node")).distinct()))
        sets = _with_sets(rows.select("_t"), "_t", "set", wanted=_wanted(wanted)).select("node", "set").join(wanted, "node")
        found = staged(sets.groupBy("a", "t").applyInArrow(_compared, "a long, b long").distinct())
        dropped(left, many, wanted)
        return found

    known, seen, sampled = _frequent(rows)
    spark = rows.sparkSession
    prefixes = _with_sets(rows.select("_t"), "_t", "prefix", (known, seen))
    posted = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "x"))
    hot = known[seen >= max(HOT_SHARE * sampled, 3)].view(np.int64).tolist()  # of 1 / HOT_SHARE texts at most
    hot = spark.createDataFrame([(x, True) for x in hot], "x long, hot boolean")
    posted = posted.join(F.broadcast(hot), "x", "left").select("x", F.when(F.col("hot"), F.pmod("node", F.lit(SALTS)) + 1).otherwise(0).cast("int").alias("s"), "node", F.expr("n * 2147483648L + pos").alias("at"))
    per = Window.partitionBy("x", "s")
    # Shingles of the same sets, as those of a passage are, get one name and go on as one.
    live = posted.withColumns({"low": F.min("node").over(per), "high": F.max("node").over(per), "sets": F.xxhash64(F.bit_xor(F.xxhash64("node")).over(per), F.sum(F.shiftright(F.xxhash64("node"), 24)).over(per), F.count("*").over(per))})
    live = live.where("s > 0 OR low <> high").select("x", F.when(F.col("s") > 0, F.col("x")).otherwise(F.col("sets")).alias("sets"), "node", F.expr("at div 2147483648L").alias("n"), F.expr("at % 2147483648L").alias("pos"))
    live = staged(live.distinct())
    # After the first shared shingle, what no other prefix has counts for nothing in one of the two sets at least: a shingle
    # of the one prefix that stands outside the other one comes after all of that, so those that the other has are seen.
    own = Window.partitionBy("node")
    bound = lambda most: F.expr(f"({most}) * {OVER + UNDER} div {OVER} - n")
    ranked = live.withColumns({"after": F.row_number().over(own.orderBy(F.desc("pos"))) - 1, "before": F.lead("sets").over(own.orderBy(F.desc("pos"))), "rank": F.count("*").over(own)})
    ranked = ranked.select(F.col("sets").alias("x"), "node", "n", "rank", "pos", "before", bound("n - pos").alias("most"), bound(f"(n * {OVER} + {UNDER - 1}) div {UNDER} + after").alias("tight"))
    ranked = staged(ranked.groupBy("x", "node", "n").agg(F.max("rank").alias("rank"), F.max("most").alias("most"), F.max("tight").alias("tight"), F.min_by("before", "pos").alias("before")))
    dropped(live)
    live = ranked.drop("rank")
    best = ranked.groupBy("x", "n").agg(F.count("*").alias("alike"), F.max(F.struct("rank", "node", "most", "tight")).alias("m"))
    best = best.groupBy("x").agg(F.max(F.struct("alike", "m", "n")).alias("b")).select("x", F.struct("b.m.node", "b.n", "b.m.most", "b.m.tight").alias("centre"))
    star = live.join(best, "x").where((F.col("centre.node") != F.col("node")) & meets(F.col("centre"), F.struct("n", "most", "tight"))).select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()
    replicas = replicated(marks.select("node", "f0"))
    star = verified(links(replicas).union(star))
    dropped(replicas)
    roots = components(star)
    rooted = live.join(roots, "node", "left").select("x", "node", "n", "most", "tight", "before", F.coalesce("root", "node").alias("root"))
    # Only pairs of two roots are left: those of a shingle with one root go, and the largest root meets the others but not itself.
    mains = rooted.groupBy("x", "root").agg(F.count("*").alias("c")).groupBy("x").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1")
    mixed = staged(rooted.join(mains.drop("roots"), "x").distinct())
    bucket = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")
    least = F.expr(f"(n * {OVER} + {UNDER - 1}) div {UNDER}")
    asks = mixed.withColumns({"low": least, "high": F.least("n", "most")}).where("low <= high").withColumn("main", F.col("root") == F.col("main"))
    asks = asks.select("x", "main", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("bucket"), F.struct("node", "n", "most", "tight", "before", "root").alias("p"))
    index = mixed.where("most >= n").select("x", F.explode(F.when(F.col("root") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("main"), bucket(F.col("n")).alias("bucket"), F.struct("node", "n", "most", "tight", "before", "root").alias("q"))
    # With the same shared shingle before it, one is not the first that the two share.
    first = F.coalesce(F.col("p.before") != F.col("q.before"), F.lit(True))
    cross = asks.join(index, ["x", "main", "bucket"]).where((F.col("p.root") != F.col("q.root")) & first & (F.col("q.n") <= F.col("p.n")) & meets(F.col("p"), F.col("q")))
    found = star.union(verified(cross.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))))
    dropped(ranked, mixed)
    return found


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest key's; of its texts, the smallest hash's."""
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    named = staged(_with_sets(rows.select("_k", "_t", F.xxhash64("_t").alias("h1"), F.xxhash64(F.lit(1), "_t").alias("h2")), "_t", "mark"))
    marks = staged(named.groupBy("node").agg(F.first("n").alias("n"), F.first("f0").alias("f0"), F.first("mark").alias("mark")))
    roots = components(similar(rows, marks)).withColumnRenamed("node", "at")
    low = F.min(F.struct(F.col("_k").alias("k"), "h1", "h2")).alias("s")
    lows = named.groupBy("node").agg(low)
    stay = staged(lows.join(roots, lows["node"] == roots["at"], "left").groupBy(F.coalesce("root", "node")).agg(F.min("s").alias("s")).select("s.*"))
    again = named.groupBy(F.col("_k").alias("k"), "h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    names = {n: fresh_name(docs, n) for n in ("k", "h1", "h2")}
    own = docs.withColumns({names["h1"]: F.xxhash64(F.col(text).cast("string")), names["h2"]: F.xxhash64(F.lit(1), F.col(text).cast("string"))})
    stay = stay.select(*[F.col(n).alias(names[n]) for n in names])
    kept = own.join(stay.hint("shuffle_hash"), F.col(key).eqNullSafe(stay[names["k"]]) & (own[names["h1"]] == stay[names["h1"]]) & (own[names["h2"]] == stay[names["h2"]]))
    kept = kept.select(*[own[c] for c in own.columns])
    repeated = not again.isEmpty()
    dropped(named, marks)
    if repeated:  # rows of one key and text: one of them stays
        kept = kept.dropDuplicates([key, names["h1"], names["h2"]])
    return kept.select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
