"""Benchmark decontamination by the CGK random-walk embedding and bit sampling.

Texts and benchmark items are read as words (runs of letters and digits, case folded). A walk reads a word sequence:
at step j it notes the word under its pointer, and a random function of j and of the word decides whether the pointer
moves on. Two sequences of small edit distance walk in step again soon after each edit, so the notes of most steps
agree: edit distance has become Hamming distance. A repetition has its own walk and notes a few sampled steps; a
window of a text and an item are candidates if all of them agree in some repetition. Windows begin at every word of
every text and are as long as the item; each candidate is verified by the exact edit distance between the item and
any run of words at that place, which may be a fifth of the item's words at most.

All windows of a block walk in lockstep. A window leaves a repetition at the first sampled word that no item has
there, so most windows take a few steps only, and a candidate needs enough of the item's word pairs around it before the
edit distance is computed. Items are grouped by size, as the walk's length depends on it. How many repetitions a
group gets is found by simulation on its own items, edited at the threshold, for the recall asked for. Items of 128 words
and more are cut into pieces of 64 words or a little more, as a walk of a long item seldom agrees: of an item with a fifth
of its words edited some piece has a fifth at most, so a piece brings the item to the exact check.

The items are the stated query set. They go to the executors in parts of at most `part_bytes` of text and `part_items` items,
so that a part's tables (some 64 bytes of marks for each item, sample and repetition, and the items' words) stay in the
tens of megabytes; each part is a pass over the texts. Documents are neither shuffled nor collected.

Defined results: null or wordless texts and items match nothing; equal items each match; repeated rows each come
back; a document has one row for each item it holds: the place of the fewest edits, the first of equals. Very long
texts are read whole, block by block and a longer text in a block of its own; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, in_arrow, mix64, row_words, small, table, utf8, word_hashes

#: Edits allowed, as a share of the item's words.
EDITS = 0.2
TARGET_RECALL = 0.98
SAMPLED = 3
#: Items of twice as many words are looked for by pieces of about so many.
PIECE = 64
#: A simulation still short of the asked recall after so many repetitions is an error.
MOST_REPETITIONS = 1000
PART_BYTES, PART_ITEMS = 4_000_000, 4096
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_U = np.uint64


def fold(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; as many bytes as before."""
    out = _FOLD[raw]
    if len(raw) > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def symbols(raw: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row, start, end): a symbol for each word of the rows a to b, and a zero after each row, which no walk leaves."""
    lo = int(offsets[a])
    folded = fold(raw[lo : int(offsets[b])])
    starts, ends, rows = row_words(folded, offsets[a : b + 1] - lo, 0, b - a, _GAP)
    hashes = word_hashes(folded, starts, ends, _GAP)
    starts, ends, rows = starts + lo, ends + lo, rows + a
    hashes[hashes == 0] = 1
    place = np.arange(len(starts)) + (rows - a)
    sym, row = np.zeros(len(starts) + b - a, np.uint64), np.full(len(starts) + b - a, -1)
    at = np.zeros((2, len(sym)), np.int64)
    sym[place], row[place], at[0, place], at[1, place] = hashes, rows, starts, ends
    return sym, row, at[0], at[1]


def _pairs(sym: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one, in 40 bits."""
    after = np.append(sym[1:], _U(0))
    return (mix64(sym * _U(0x9E3779B97F4A7C15) + after * _U(0xC2B2AE3D27D4EB4F)) >> _U(24)).astype(np.int64)


@dataclass
class Repetition:
    turns: np.ndarray  # a multiplier for each step up to the last sampled one
    steps: np.ndarray  # the sampled steps
    shift: np.uint64 = _U(0)
    seen: list[np.ndarray] = field(default_factory=list)  # after each sample, marks of what the items have noted so far
    notes: np.ndarray | None = None  # sorted; what the items have noted at the end
    owner: np.ndarray | None = None  # the piece of each


@dataclass
class Group:
    items: np.ndarray  # places in the part's list of pieces
    repetitions: list[Repetition]


@dataclass
class Part:
    ids: list
    words: list[np.ndarray]
    allowed: np.ndarray
    pieces: list[np.ndarray]
    item: np.ndarray  # of each piece
    offset: np.ndarray  # of each piece in its item
    spare: np.ndarray  # edits allowed in each piece
    pairs: np.ndarray  # sorted: place of the piece and hash of two words that follow each other in it
    groups: list[Group]


def _walk(sym: np.ndarray, at: np.ndarray, rep: Repetition, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(indices into `at`, notes) of the walks from the places `at` that end; with marks, those that no item shares leave early."""
    who, pointer, note = np.arange(len(at)), at.astype(np.int64), np.zeros(len(at), np.uint64)
    k = 0
    for j in range(int(rep.steps[-1]) + 1):
        here = sym[pointer]
        if j == rep.steps[k]:
            note = (note ^ here) * _U(0x9E3779B97F4A7C15) + _U(1)
            note ^= note >> _U(29)
            if marks:
                stay = np.flatnonzero(rep.seen[k][(note >> rep.shift).astype(np.int64)])
                who, pointer, note, here = who[stay], pointer[stay], note[stay], here[stay]
            k += 1
        pointer = pointer + ((here * rep.turns[j]) >> _U(63)).view(np.int64)
    return who, note


def _repetition(rng: np.random.Generator, span: int) -> Repetition:
    """Sampled steps: the first one early, as all windows walk there; the rest anywhere in the span."""
    first = int(rng.integers(0, max(1, min(4, span - SAMPLED + 1))))
    rest = rng.choice(np.arange(first + 1, max(span, first + SAMPLED)), SAMPLED - 1, replace=False)
    steps = np.sort(np.concatenate(([first], rest)))
    return Repetition(rng.integers(0, 2**63, int(steps[-1]) + 1, dtype=np.uint64) * _U(2) + _U(1), steps)


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        kind, i = int(rng.integers(3)), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[i] = int(rng.integers(1, 2**63))
        elif kind == 1 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, int(rng.integers(1, 2**63)))
    return np.array(out, np.uint64)


def _fit_group(items: list[np.ndarray], allowed: np.ndarray, rng: np.random.Generator, recall: float) -> list[Repetition]:
    """As many repetitions as find the asked share of simulated copies with as many edits as are allowed."""
    span = max(SAMPLED, min(len(w) for w in items) * 3 // 2)
    picked = rng.choice(len(items), 400)
    tries, starts, base = [], [], 0
    for i in picked:
        lead, tail = rng.integers(1, 2**63, 3, dtype=np.uint64), rng.integers(1, 2**63, 80, dtype=np.uint64)
        copy = np.concatenate((lead, _edited(items[i], int(allowed[i]), rng), tail, np.zeros(1, np.uint64)))
        tries.append(copy)
        starts.append(base + np.arange(min(8, len(copy) - 1)))
        base += len(copy)
    sym, at = np.concatenate(tries), np.concatenate(starts)
    of = np.repeat(np.arange(len(picked)), [len(s) for s in starts])
    own = np.concatenate([np.append(items[i], _U(0)) for i in picked])
    first = np.cumsum([0, *[len(items[i]) + 1 for i in picked[:-1]]])
    found, reps = np.zeros(len(picked), bool), []
    while found.mean() < recall or len(reps) < 2:
        if len(reps) == MOST_REPETITIONS:
            raise RuntimeError(f"simulated recall {found.mean():.3f} of {recall} for items of {min(len(w) for w in items)} words and more")
        rep = _repetition(rng, span)
        wanted = _walk(own, first, rep, marks=False)[1]
        noted = _walk(sym, at, rep, marks=False)[1]
        found[of[noted == wanted[of]]] = True
        reps.append(rep)
    return reps


def prepare(ids: list, texts: list[str], edits: float = EDITS, recall: float = TARGET_RECALL, seed: int = 17) -> Part:
    """The tables of some items."""
    column = pa.array(texts, pa.string())
    raw, offsets, _ = utf8(column)
    words, kept = [], []
    for r, i in enumerate(ids):
        sym = symbols(raw, offsets, r, r + 1)[0][:-1]
        if len(sym):
            words.append(sym)
            kept.append(i)
    allowed = np.array([int(edits * len(w)) for w in words], np.int64)
    pieces, item, offset = [], [], []
    for k, w in enumerate(words):
        cuts = np.array_split(w, max(1, len(w) // PIECE)) if len(w) >= 2 * PIECE else [w]
        pieces += cuts
        item += [k] * len(cuts)
        offset += np.cumsum([0, *[len(c) for c in cuts[:-1]]]).tolist()
    spare = np.array([int(edits * len(w)) for w in pieces], np.int64)
    pairs = np.unique(np.concatenate([(k << 40) + _pairs(w)[:-1] for k, w in enumerate(pieces)])) if pieces else np.empty(0, np.int64)
    rng, groups = np.random.default_rng(seed), []
    size = np.array([len(w).bit_length() - 1 >> 1 for w in pieces])
    for g in np.unique(size):
        own = np.flatnonzero(size == g)
        reps = _fit_group([pieces[k] for k in own], spare[own], rng, recall)
        flat = np.concatenate([np.append(pieces[k], _U(0)) for k in own])
        first = np.cumsum([0, *[len(pieces[k]) + 1 for k in own[:-1]]])
        for rep in reps:
            note, pointer, k = np.zeros(len(own), np.uint64), first.astype(np.int64), 0
            for j in range(int(rep.steps[-1]) + 1):
                here = flat[pointer]
                if j == rep.steps[k]:
                    note = (note ^ here) * _U(0x9E3779B97F4A7C15) + _U(1)
                    note ^= note >> _U(29)
                    # 64 marks for each item, so that few others share one; as few as that to stay in the processor's cache.
                    marks = np.zeros(1 << max(12, min(22, len(own).bit_length() + 6)), bool)
                    rep.shift = _U(64 - len(marks).bit_length() + 1)
                    marks[(note >> rep.shift).astype(np.int64)] = True
                    rep.seen.append(marks)
                    k += 1
                pointer = pointer + ((here * rep.turns[j]) >> _U(63)).astype(np.int64)
            order = np.argsort(note, kind="stable")
            rep.notes, rep.owner = note[order], own[order]
        groups.append(Group(own, reps))
    return Part(kept, words, allowed, pieces, np.array(item, np.int64), np.array(offset, np.int64), spare, pairs, groups)


def candidates(sym: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of the windows that agree with a piece in some repetition and have enough of its words around."""
    places = np.flatnonzero(sym)
    found = []
    for group in part.groups:
        for rep in group.repetitions:
            who, note = _walk(sym, places, rep, marks=True)
            lo, hi = np.searchsorted(rep.notes, note, "left"), np.searchsorted(rep.notes, note, "right")
            n = hi - lo
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(places[np.repeat(who, n)] * len(part.pieces) + rep.owner[np.repeat(lo, n) + nth])
    packed = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    at, piece = np.divmod(packed, len(part.pieces)) if len(packed) else (packed, packed)
    if not len(at):
        return at, piece
    # An edit breaks two pairs of adjacent words at most, so the other pairs of the piece stand in the text nearby.
    sizes = np.array([len(w) for w in part.pieces])
    if not len(part.pairs):  # items of one word
        return at, piece
    need, span = (sizes - 1 - 2 * part.spare)[piece], (sizes + 2 * part.spare)[piece]
    have, low = np.zeros(len(at), np.int64), at - part.spare[piece]
    pair = _pairs(sym)
    live = np.arange(len(at))
    for o in range(int(span.max())):
        live = live[(o < span[live]) & (have[live] + span[live] - o >= need[live]) & (have[live] < need[live])]
        p = low[live] + o
        ok = (p >= 0) & (p < len(sym))
        who = live[ok]
        wanted = (piece[who] << 40) + pair[p[ok]]
        have[who] += part.pairs[np.minimum(np.searchsorted(part.pairs, wanted), len(part.pairs) - 1)] == wanted
    keep = have >= need
    return at[keep], piece[keep]


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the fewest edits between the item and any run of the region, and the first such run's place."""
    m = len(region)
    steps = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), steps.copy()
    for w in item:
        over = np.empty(m + 1, np.int64)
        over[0], over[1:] = row[0] + 1, np.minimum(row[:-1] + (region != w), row[1:] + 1)
        from_ = np.empty(m + 1, np.int64)
        from_[0] = start[0]
        from_[1:] = np.where(row[:-1] + (region != w) <= row[1:] + 1, start[:-1], start[1:])
        low = np.minimum.accumulate(over - steps)
        new = low + steps
        source = np.maximum.accumulate(np.where(over - steps == low, steps, 0))
        start = from_[source]
        row = new
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def search(raw: np.ndarray, offsets: np.ndarray, part: Part) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first byte, end byte) of the best place of each item in each row."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    place: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in blocks(offsets):
        sym, row, first, last = symbols(raw, offsets, a, b)
        if not len(sym):
            continue
        where, piece = candidates(sym, part)
        # Where the item would begin; a long one by what its pieces say, which edits before them may shift.
        at, item = where - part.offset[piece], part.item[piece]
        limits = np.flatnonzero(sym == 0)
        done: dict[tuple[int, int], int] = {}
        order = np.lexsort((at, item))
        for p, i, seen in zip(at[order].tolist(), item[order].tolist(), where[order].tolist(), strict=True):
            r = int(row[seen])
            k, words = int(part.allowed[i]), part.words[i]
            if p - done.get((r, i), -1 << 60) <= k:
                continue
            end = int(limits[np.searchsorted(limits, seen)])
            begin = int(limits[np.searchsorted(limits, seen) - 1]) + 1 if np.searchsorted(limits, seen) else 0
            n = len(words)
            if p >= begin and end - p >= n and np.array_equal(sym[p : p + n], words):
                edits, s, e = 0, p, p + n
            else:
                far = 2 * k + 8 if n >= 2 * PIECE else 0
                lo, hi = max(begin, p - k - far), min(end, p + n + 2 * k + far)
                edits, s, e = edit_distance(words, sym[lo:hi])
                s, e = s + lo, e + lo
            done[r, i] = p
            if edits <= k and e > s and (edits, s) < best.get((r, i), (1 << 30, 0, 0))[:2]:
                best[r, i] = (edits, s, e)
                place[r, i] = (edits, int(first[s]), int(last[e - 1]))
    return [(r, i, *x) for (r, i), x in sorted(place.items())]


def parts(benchmark: DataFrame, key: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES, part_items: int = PART_ITEMS) -> Iterator[tuple[list, list[str]]]:
    """The items in parts of bounded size."""
    own = benchmark.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    total, count = own.agg(F.sum(F.octet_length("t").cast("long")), F.count("*")).first()
    n = 1 + max((total or 0) // part_bytes, count // part_items)
    for p in range(n):
        rows = (own if n == 1 else own.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == p)).collect()
        rows.sort(key=lambda r: (str(r["k"]), r["t"]))
        if rows:
            yield [r["k"] for r in rows], [r["t"] for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", **options) -> DataFrame:
    """One row for each document and item it holds: key, item_key, edits, item_words, start, end (code points, end exclusive)."""
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, benchmark.schema[item_key].dataType), T.StructField("edits", T.LongType()),
        T.StructField("item_words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    out = None
    for ids, texts in parts(benchmark, item_key):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(ids, texts, **options))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value
            item_type = pa.array(part.ids).type if part.ids else pa.int64()
            for batch in small(batches, 1):
                raw, offsets, _ = utf8(batch.column(1))
                found = search(raw, offsets, part)
                if found:
                    row = [x[0] for x in found]
                    chars = lambda r, to: int(((raw[offsets[r] : to] & 0xC0) != 0x80).sum())
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row)), pa.array([part.ids[x[1]] for x in found], item_type), pa.array([x[2] for x in found], pa.int64()),
                        pa.array([len(part.words[x[1]]) for x in found], pa.int64()), pa.array([chars(x[0], x[3]) for x in found], pa.int64()), pa.array([chars(x[0], x[4]) for x in found], pa.int64()),
                    ], names=[key, item_key, "edits", "item_words", "start", "end"])

        found = in_arrow(rows, run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item. Rows are judged one by one, whatever their keys."""
    at = docs.columns.index(text)
    kept = docs
    for ids, texts in parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(ids, texts, **options))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small(batches, at):
                raw, offsets, _ = utf8(batch.column(at))
                hit = np.zeros(batch.num_rows, bool)
                hit[[x[0] for x in search(raw, offsets, shared.value)]] = True
                yield batch.filter(pa.array(~hit))

        kept = in_arrow(kept, run, docs.schema)
    return kept


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
