"""Substring dedup with prefix-partitioned suffix trees.

A window is `window` (35) consecutive words of one text; a word goes if a window that covers it starts anywhere else
too, in the same text or another. Deeper than 35 words the suffix trees are not needed, so a suffix is read down to
that depth, and a node of full depth with two leaves is a repeat; repeats that follow each other in a text make up
its maximal repeats.

1. Anchors. The anchor of a window is the run of 12 words in it with the smallest hash. Equal windows have equal
   anchors, so suffixes are told apart by the anchor first: it is their prefix. Only the anchors (one word in
   thirteen) are shuffled and counted; windows whose anchor stands nowhere else are no repeats and end here.
2. Groups. Suffixes under one anchor form a group of known size. An anchor under which more suffixes stand than fit
   one group has its prefix extended by as many bits of the path below it as needed; small ones share a group. So
   prefixes of variable length cut the suffixes into groups of a size that fits a task's memory.
3. Subtrees. A suffix travels as its path: 128 bits of rolling hashes of its 35 words. A batch first builds the
   subtree of its own suffixes, marks the repeats it sees and sends one leaf for each path. In each group the
   suffixes are sorted by path, and full-depth nodes are runs of equal paths.
4. Marked places go back to their texts, which lose the covered words.

Of the texts themselves, those that hold a repeated anchor are shuffled, and few others: a broadcast table of 2^25 bits
leaves the rest where they are, and a join by name settles what it lets through. A fuller table only lets more through.

Texts that are equal count once: all windows of a text with copies are repeats. A passage that a third of all texts
share sends a leaf for each batch, not for each text. Whole texts are read, nothing is capped. Words are those of
`[^\\x20\\x09-\\x0D]+`, unchanged.

Defined results: a null or empty text has no words, and its kept words are empty; a text shorter than the window
keeps all. Keys may be null or repeated; every row comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, dropped, in_arrow, long_id, mix64, row_words, small, staged, table, utf8, word_hashes

WINDOW = 35
ANCHOR = 12
#: Suffixes of a group.
GROUP_ROWS = 200_000
#: Bits, as a power of two, of the table that says which texts may be wanted: 524,288 rows of 64 bits at most, 21 MB as broadcast.
FILTER_BITS = 25
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, width: int, which: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    n = len(hashes)
    if n < width:
        return np.empty(0, _U)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * _powers(_BASES[which], n))))
    return mix64((sums[width:] - sums[:-width]) * _powers(_INVERSES[which], n - width + 1))


def windows(raw: np.ndarray, offsets: np.ndarray, a: int, b: int, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, anchor's place, anchor's hash, word hashes) of the windows of the rows a to b; places count the block's words."""
    starts, ends, rows = row_words(raw, offsets, a, b)
    hashes = word_hashes(raw, starts, ends)
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none.astype(_U), hashes
    seeds = rolling(hashes, anchor, 0)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window - anchor + 1)
    first = np.flatnonzero(rows[: len(hashes) - window + 1] == rows[window - 1 :])
    place = view.argmin(axis=1)[first] + first
    return rows[first], first, place, seeds[place], hashes


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _t, h1, h2): the key, the text, and 128 bits that name the text."""
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    return rows.select("_k", "_t", F.xxhash64("_t").alias("h1"), F.xxhash64(F.lit(1), "_t").alias("h2"))


def wanted(rows: DataFrame, leads: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose name h1 may be one of leads: all that are, and a part of the others (their share of set bits)."""
    word, bit = F.shiftrightunsigned(F.col("h1").bitwiseAND(F.lit(2**bits - 1)), 6), F.expr("shiftleft(1L, cast(h1 & 63 AS int))")
    words = leads.groupBy(word.alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_w", word).join(F.broadcast(words), "_w").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_w", "_bits")


def facts(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """For each row: key, name of the text, words, digest of all its words, and its anchors (one that stands twice, twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            raw, offsets, valid = utf8(batch.column(1))
            n = len(valid)
            count, digest = np.zeros(n, np.int64), []
            for r in range(n):
                words = raw[offsets[r] : offsets[r + 1]].tobytes().split()
                count[r] = len(words)
                digest.append(hashlib.sha256(b" ".join(words)).digest())
            found, sizes = [], np.zeros(n, np.int64)
            for a, b in blocks(offsets):
                row, _, place, seed, _ = windows(raw, offsets, a, b, window, anchor)
                new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.empty(0, bool)
                found.append(seed[new])
                sizes += np.bincount(row[new], minlength=n)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(count), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["_k", "h1", "h2", "n_words", "digest", "anchors"])

    kind = rows.schema["_k"].dataType.simpleString()
    return in_arrow(rows, run, f"_k {kind}, h1 long, h2 long, n_words long, digest binary, anchors array<long>")


def _intervals(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as (first, number) of runs that follow each other."""
    if not len(place):
        return place, place
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1] + 1)))
    return place[head], np.diff(np.concatenate((head, [len(place)])))


def suffixes(candidates: DataFrame, n_groups: int, window: int, anchor: int) -> DataFrame:
    """Leaves of each batch's subtree. weight 1: a place to mark if the path stands elsewhere; 2: the path is a repeat, nothing to mark; 0: places already marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 3):
            h1, h2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            copies = np.asarray(batch.column(2)).astype(np.int64)
            raw, offsets, _ = utf8(batch.column(3))
            lists = batch.column(4)
            for a, b in blocks(offsets, 1 << 22):
                pairs = lists.slice(a, b - a).flatten()
                known, at = np.unique(np.asarray(pairs.field(0)).view(_U), return_index=True)
                often = np.asarray(pairs.field(1))[at]
                row, first, _, seed, hashes = windows(raw, offsets, a, b, window, anchor)
                if not len(known) or not len(row):
                    continue
                slot = np.minimum(np.searchsorted(known, seed), len(known) - 1)
                live = known[slot] == seed
                if not live.any():
                    continue
                row, first, seed, often = row[live], first[live], seed[live], often[slot[live]]
                p1, p2 = rolling(hashes, window, 1)[first], rolling(hashes, window, 2)[first]
                began = np.searchsorted(row_words(raw, offsets, a, b)[2], row)  # the row's first word in the block
                start = first - began
                order = np.lexsort((first, p2, p1))
                row, start, p1, p2, seed, often = row[order], start[order], p1[order], p2[order], seed[order], often[order]
                new = np.concatenate(([True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])))
                head = np.flatnonzero(new)
                run_of = np.cumsum(new) - 1
                weight = np.bincount(run_of, weights=np.minimum(copies[row], 2)).astype(np.int64)
                # What repeats within the batch is marked at once, as intervals.
                marked = np.flatnonzero((weight[run_of] >= 2) & (copies[row] < 2))
                marked = marked[np.lexsort((start[marked], row[marked]))]
                place, length = _intervals(start[marked] + row[marked] * (1 << 40))
                m_row = place >> 40
                # An anchor with more suffixes than a group holds goes by as many further bits of the path.
                extra = np.ceil(np.log2(np.maximum(often[head] * (window - anchor + 1) / GROUP_ROWS, 1))).astype(np.int64)
                below = np.where(extra > 0, p1[head] >> (64 - np.maximum(extra, 1)).astype(_U), _U(0))
                group = (mix64(seed[head] + below * _U(0x9E3779B97F4A7C15)) % _U(n_groups)).astype(np.int64)
                spread = (mix64(h1[m_row].view(_U) + place.astype(_U)) % _U(n_groups)).astype(np.int64)
                heads = len(head)
                n = heads + len(place)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((group, spread)).astype(np.int32)), pa.array(np.concatenate((p1[head].view(np.int64), np.zeros(len(place), np.int64)))), pa.array(np.concatenate((p2[head].view(np.int64), np.zeros(len(place), np.int64)))),
                    pa.array(np.concatenate((h1[row[head]], h1[m_row]))), pa.array(np.concatenate((h2[row[head]], h2[m_row]))), pa.array(np.concatenate((start[head], place & ((1 << 40) - 1)))),
                    pa.array(np.concatenate((np.ones(heads, np.int64), length)).astype(np.int32)), pa.array(np.where(np.arange(n) < heads, np.append(np.minimum(weight, 2), np.zeros(len(place), np.int64)), 0).astype(np.int8)),
                ], names=["g", "p1", "p2", "h1", "h2", "start", "length", "weight"])

    return in_arrow(candidates, run, "g int, p1 long, p2 long, h1 long, h2 long, start long, length int, weight byte")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked places of suffixes sorted by path; a run of equal paths may go over the end of a batch."""
    names = ["p1", "p2", "h1", "h2", "start", "length", "weight"]
    held: dict[str, np.ndarray] | None = None

    def close(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.concatenate(([True], (c["p1"][1:] != c["p1"][:-1]) | (c["p2"][1:] != c["p2"][:-1])))
        run_of = np.cumsum(new) - 1
        total = np.bincount(run_of, weights=c["weight"])
        keep = (c["weight"] == 0) | (c["weight"] == 1) & (total[run_of] >= 2)
        return pa.RecordBatch.from_arrays([pa.array(c[k][keep]) for k in ("h1", "h2", "start", "length")], names=["h1", "h2", "start", "length"])

    for batch in batches:
        now = {k: np.asarray(batch.column(batch.schema.get_field_index(k))) for k in names}
        if held is not None:
            now = {k: np.concatenate((held[k], now[k])) for k in names}
        if not len(now["p1"]):
            continue
        other = np.flatnonzero((now["p1"] != now["p1"][-1]) | (now["p2"] != now["p2"][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield close({k: v[:cut] for k, v in now.items()})
        held = {k: v[cut:].copy() for k, v in now.items()}
    if held is not None and len(held["p1"]):
        yield close(held)


def _without(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes]]]:
    """Each batch of (h1, h2, text, places) with the words removed and the kept text of each row."""
    for batch in small(batches, 2):
        raw, offsets, valid = utf8(batch.column(2))
        gone, kept = np.zeros(len(valid), np.int64), []
        for r, places in enumerate(batch.column(3)):
            words = raw[offsets[r] : offsets[r + 1]].tobytes().split()
            change = np.zeros(len(words) + 1, np.int64)
            start, length = (np.asarray(places.values.field(i)).astype(np.int64) for i in (0, 1))
            np.add.at(change, start, 1)
            np.add.at(change, start + length + window - 1, -1)
            covered = np.cumsum(change[:-1]) > 0
            gone[r] = int(covered.sum())
            kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]))
        yield batch, gone, kept


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, kept_text: bool = False) -> DataFrame:
    """One row for each row of df: key, n_words, n_removed, kept_sha256 (binary); with kept_text, also the kept words joined by one space, null where nothing went."""
    rows = _texts(df, key, text)
    known = staged(facts(rows, window, anchor))
    # A text is worked on at the row with its smallest key; rows with equal keys and texts do the same work twice, with the same result.
    texts = known.where(F.col("n_words") >= window).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(F.coalesce("_k", F.lit(-(2**63)).cast(df.schema[key].dataType))).alias("lead"), F.any_value("anchors").alias("anchors"))
    texts = staged(texts)
    each = texts.select("h1", "h2", F.explode("anchors").alias("anchor"))
    repeated = staged(each.groupBy("anchor").agg(F.count("*").alias("often")).where("often > 1"))
    total = repeated.agg(F.sum("often")).first()[0] or 0
    # A text is one row of texts, so its anchors are told apart there, without a shuffle.
    own = texts.select("h1", "h2", F.explode(F.array_distinct("anchors")).alias("anchor")).join(repeated, "anchor").groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "often")).alias("anchors"))
    leads = staged(texts.select("h1", "h2", "copies", "lead").join(own, ["h1", "h2"]))
    bodies = wanted(rows, leads).withColumn("lead", F.coalesce("_k", F.lit(-(2**63)).cast(df.schema[key].dataType)))
    candidates = staged(bodies.join(leads.hint("shuffle_hash"), ["h1", "h2", "lead"]).select("h1", "h2", "copies", "_t", "anchors"))
    dropped(repeated, leads)
    n_groups = max(1, -(-total * (window - anchor + 1) // GROUP_ROWS))
    leaves = suffixes(candidates, n_groups, window, anchor)
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = leaves.repartition(max(n_groups, shuffles), "g").sortWithinPartitions("p1", "p2").mapInArrow(_repeats, "h1 long, h2 long, start long, length int")
    marked = placed.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    single = candidates.where("copies = 1").select("h1", "h2", "_t").join(marked.hint("shuffle_hash"), ["h1", "h2"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, gone, kept in _without(batches, window):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone), pa.array([hashlib.sha256(k).digest() for k in kept], pa.binary()), pa.array([k.decode() if kept_text else None for k in kept], pa.string())], names=["h1", "h2", "gone", "left", "kept_text"])

    changed = in_arrow(single.select("h1", "h2", "_t", "places"), reduce, "h1 long, h2 long, gone long, left binary, kept_text string").dropDuplicates(["h1", "h2"])
    whole = texts.where("copies > 1").select("h1", "h2", F.lit(-1).cast("long").alias("gone"), F.unhex(F.sha2(F.lit(""), 256)).alias("left"), F.lit("").alias("kept_text"))
    found = known.drop("anchors").join(changed.unionByName(whole), ["h1", "h2"], "left")
    out = found.select(F.col("_k").alias(key), "n_words", F.when(F.col("gone") == -1, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"), F.coalesce("left", "digest").alias("kept_sha256"), "kept_text")
    return out if kept_text else out.drop("kept_text")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept_sha256", F.lower(F.hex("kept_sha256")))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT rid, words, unnest(range(1, CAST(len(words) - 33 AS BIGINT))) AS i FROM docs WHERE len(words) >= 35),
seen AS (SELECT rid, i, md5(array_to_string(words[i:i + 34], ' ')) AS w FROM starts),
often AS (SELECT w FROM seen GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, k FROM (SELECT rid, unnest(range(i, i + 35)) AS k FROM seen WHERE w IN (SELECT w FROM often))),
words AS (SELECT rid, unnest(words) AS word, unnest(range(1, CAST(len(words) + 1 AS BIGINT))) AS k FROM docs),
left_over AS (
  SELECT rid, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE g.k IS NULL) AS kept
  FROM words LEFT JOIN gone g USING (rid, k) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (rid)
"""
