"""Works that arrive twice: the trigram similarity join, links between works, and rulings on them."""

from __future__ import annotations

import html
import itertools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import sequential as Q
from ..functions import text as X
from .checkpoints import cut

THRESHOLD = 0.55


#: Words of 64 bits in a row's two sketches: the first meets those of all rows, the second the rows that are left.
FIRST_WORDS, WORDS = 6, 16
#: Rows from which on they are dealt into so many blocks at least, and rows of a block at most.
SMALL, BLOCKS, BLOCK_ROWS = 4096, 12, 1 << 16
#: Texts and characters of a block of texts that are compared with each other, more or less, and groups of copies.
BLOCK_TEXTS, BLOCK_CHARS, COPY_GROUPS = 128, 1 << 19, 1024
#: Characters of a batch of marked texts.
BATCH_CHARS = 1 << 21


def _grams(words: str) -> set[str]:
    """The trigrams of words joined by spaces, as `text.trigrams` has them."""
    out: set[str] = set()
    for word in words.split(" "):
        p = f"  {word} "
        out.update([p[i : i + 3] for i in range(len(p) - 2)])
    return out


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their number of trigrams, n, and their sketches: a bit is the parity of the trigrams that fall on it, and each falls on one of either sketch."""
    masks: dict[str, int] = {}
    for batch in batches:
        n, sketch = [], []
        for words in batch.column("words").to_pylist():
            grams, x = _grams(words), 0
            for g in grams:
                if (mask := masks.get(g)) is None:
                    h = zlib.crc32(g.encode())
                    mask = masks[g] = 1 << h % (64 * FIRST_WORDS) | 1 << (64 * FIRST_WORDS + h * 2654435761 // 4096 % (64 * (WORDS - FIRST_WORDS)))
                x ^= mask
            n.append(len(grams))
            sketch.append(x.to_bytes(8 * WORDS, "little"))
            if len(masks) > 1 << 18:
                masks.clear()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), pa.array(sketch, pa.binary())], names=[*batch.schema.names, "n", "sketch"])


class _Block:
    """A block's rows by their number of trigrams, the words of their sketches one after the other."""

    def __init__(self, rows: pa.Table):
        n = rows["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        self.rows, self.n = rows.take(order), n[order]
        self.words = np.ascontiguousarray(np.frombuffer(b"".join(self.rows["sketch"].to_pylist()), "<u8").reshape(len(n), WORDS).T)
        self.known: dict[int, set[str]] = {}

    def grams(self, at: int) -> set[str]:
        if (found := self.known.get(at)) is None:
            found = self.known[at] = _grams(self.rows["words"][at].as_py())
        return found


def _candidates(a: _Block, b: _Block, threshold: float, high: int = 32, wide: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in both blocks of the pairs that sketches and lengths leave open, each pair once."""
    share = (1 - threshold) / (1 + threshold)
    x, c, h = np.empty((high, wide), np.uint64), np.empty((high, wide), np.uint8), np.empty((high, wide), np.uint8)
    for i in range(0, len(a.n), high):
        rows = min(high, len(a.n) - i)
        first = int(np.searchsorted(b.n, a.n[i] * threshold - 1e-6))
        last = int(np.searchsorted(b.n, a.n[i + rows - 1] / threshold + 1e-6, "right"))
        for j in range(max(first, i) if a is b else first, last, wide):
            cols = min(wide, last - j)
            xs, cs, hs = x[:rows, :cols], c[:rows, :cols], h[:rows, :cols]
            for w in range(FIRST_WORDS):
                np.bitwise_xor(a.words[w, i : i + rows, None], b.words[w, None, j : j + cols], out=xs)
                np.bitwise_count(xs, out=cs if w else hs)
                if w:
                    np.add(hs, cs, out=hs)  # past 255 it begins anew, which leaves a pair open
            most = np.minimum((a.n[i + rows - 1] + b.n[j : j + cols]) * share + 1e-6, 255).astype(np.uint8)
            p, q = np.nonzero(hs <= most)
            p, q = p + i, q + j
            if a is b:
                p, q = p[p < q], q[p < q]
            apart = sum(np.bitwise_count(a.words[w, p] ^ b.words[w, q]).astype(np.int32) for w in range(FIRST_WORDS, WORDS))
            near = apart <= (a.n[p] + b.n[q]) * share + 1e-6
            if near.any():
                yield p[near], q[near]


def _meet(threshold: float, blocks: int, kind: pa.DataType):
    """The pairs of two blocks, or of one, that reach the threshold."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = divmod(key[0].as_py(), blocks)
        own = rows["block"].to_numpy()
        a = _Block(rows.filter(pa.array(own == i)))
        b = a if i == j else _Block(rows.filter(pa.array(own == j)))
        first, second, scores = [], [], []
        for p, q in _candidates(a, b, threshold) if len(a.n) and len(b.n) else ():
            for s, t in zip(p.tolist(), q.tolist(), strict=True):
                shared = len(a.grams(s) & b.grams(t))
                score = shared / (int(a.n[s]) + int(b.n[t]) - shared)
                if score >= threshold:
                    x, y = a.rows["lead"][s].as_py(), b.rows["lead"][t].as_py()
                    first.append(min(x, y))
                    second.append(max(x, y))
                    scores.append(score)
        return pa.table({"first": pa.array(first, kind), "second": pa.array(second, kind), "score": pa.array(scores, pa.float64())})

    return run


def similar_pairs(works: DataFrame, id_: str = "id", signature: str = "signature", threshold: float = THRESHOLD) -> DataFrame:
    """(first, second, score, matched_on) of works whose signatures' trigram similarity reaches the threshold.

    Of two works with m and n trigrams, of similarity t or more, at most (m + n) * (1 - t) / (1 + t) are of one alone, and
    either sketch differs in no more bits than that. Blocks of rows meet in pairs; rows that sketches and lengths leave open are
    scored by their trigrams, so no pair is lost. Prefixes prune little here, as the trigrams of a language are few: the
    work grows with the square of the number of different signatures, at some 11 ns a pair. Equal signatures are one row
    until the end; they link in a star to the smallest id and to each other through it, so a group of copies yields as
    many rows as it has copies.
    """
    # Signatures are worked out once: what reads them reads them from there.
    rows = cut(works.select(F.col(id_).alias("id"), F.col(signature).alias("s"))).where(X.blank(F.col("s")) != "")
    groups = cut(rows.groupBy("s").agg(F.min("id").alias("lead")).withColumn("words", F.array_join(X.trigram_words(F.col("s")), " ")).where("words <> ''"))
    n = groups.count()
    blocks = 1 if n <= SMALL else max(BLOCKS, -(-n // BLOCK_ROWS))
    kind = groups.schema["lead"].dataType
    dealt = groups.select("lead", "words", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("block"))
    sketched = dealt.mapInArrow(_sketches, f"lead {kind.simpleString()}, words string, block int, n int, sketch binary")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    met = sketched.withColumn("key", F.explode(F.transform(others, lambda o: F.least("block", o).cast("long") * blocks + F.greatest("block", o))))
    near = met.groupBy("key").applyInArrow(_meet(threshold, blocks, to_arrow_type(kind)), f"first {kind.simpleString()}, second {kind.simpleString()}, score double")
    same = rows.join(groups.select("s", "lead"), "s").where(F.col("id") != F.col("lead")).select(F.col("lead").alias("first"), F.col("id").alias("second"), F.lit(1.0).alias("score"))
    return near.withColumn("matched_on", F.lit("fuzzy")).unionByName(same.withColumn("matched_on", F.lit("opening"))).withColumn("score", F.bround("score", 3))


#: What a row of a group is: a text of the first or the second block, a copy, or a link between signatures of either block.
_FIRST, _SECOND, _COPY, _LINK = range(4)


def _mark(kind: pa.DataType):
    """The marked differences of the texts of two blocks, or of one, whose signatures are linked; and copies as they are."""
    schema = pa.schema([("first", kind), ("second", kind), ("first_html", pa.string()), ("second_html", pa.string()), ("differences", pa.int32())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        texts: dict = {}
        blocks: tuple[dict, dict] = {}, {}  # ids by the signature's lead
        links = []
        for batch in batches:
            for what, first, second, text in zip(*(batch.column(c).to_pylist() for c in ("what", "first", "second", "text")), strict=True):
                if what == _COPY:
                    shown = html.escape(text)
                    yield first, second, shown, shown, 0
                elif what == _LINK:
                    links.append((first, second))
                else:
                    texts[second] = text
                    blocks[what].setdefault(first, []).append(second)
        pairs: dict = {}
        for x, y in links:
            own, others = blocks[0][x], (blocks[1] or blocks[0])[y]
            for a, b in itertools.combinations(own, 2) if own is others else itertools.product(own, others):
                pairs.setdefault(min(a, b), []).append(max(a, b))
        yield from Q.all_differences(texts, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in found(batches):
            rows.append(row)
            size += len(row[2]) + len(row[3])
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def marked_differences(works: DataFrame, id_: str = "id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(first, second, first_html, second_html, differences) of all pairs of different texts whose signatures' similarity
    reaches the threshold, equal signatures among them, and of each further copy of a text with the copy of the smallest id.

    A text stands for its copies. Links are found between signatures, a lead for each, and become pairs of texts where the
    texts are: blocks of texts meet in pairs. A text is in a block with the smallest lead that its own is linked to, which
    brings most of a group of near copies together; the large groups are dealt into several blocks.
    """
    read = works.select(F.col(id_).alias("id"), X.blank(F.col(text)).alias("text"))
    rows = cut(read.select("id", X.signature(F.col("text")).alias("s"), F.sha2("text", 256).alias("h"), F.length("text").alias("n"))).where("s <> ''")
    kind = rows.schema["id"].dataType
    own = rows.groupBy("s", "h").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    leads = own.groupBy("s").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    near = similar_pairs(rows, "id", "s", threshold).where("matched_on = 'fuzzy'").select("first", "second")
    links = cut(near.unionByName(leads.where("k > 1").select(F.col("lead").alias("first"), F.col("lead").alias("second"))))

    ends = links.unionByName(links.select(F.col("second").alias("first"), F.col("first").alias("second")))
    labels = ends.groupBy(F.col("first").alias("lead")).agg(F.least(F.min("second"), F.first("first")).alias("label")).join(leads, "lead")
    parts = lambda k, n: F.ceil(F.greatest(F.col(k) / BLOCK_TEXTS, F.col(n) / BLOCK_CHARS))
    subs = labels.groupBy("label").agg(F.sum("k").alias("_k"), F.sum("n").alias("_n")).select("label", parts("_k", "_n").alias("subs"))
    dealt = labels.join(subs, "label").select("s", "lead", "label", F.pmod(F.xxhash64("lead"), "subs").alias("sub"), parts("k", "n").alias("parts"))
    block = F.struct("label", "sub", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    placed = cut(own.join(dealt, "s").select("id", "lead", block.alias("block")))

    at = placed.select("lead", "block").distinct()
    met = links.join(at.select(F.col("lead").alias("first"), F.col("block").alias("b1")), "first").join(at.select(F.col("lead").alias("second"), F.col("block").alias("b2")), "second")
    turned = F.col("b1") > F.col("b2")
    turn = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    met = cut(met.where("first <> second OR b1 <= b2").select(turn("b1", "b2", "b1"), turn("b2", "b1", "b2"), turn("first", "second", "first"), turn("second", "first", "second")))
    sides = met.select("b1", "b2", F.lit(_FIRST).alias("what"), F.col("first").alias("lead"), F.col("b1").alias("block"))
    sides = sides.unionByName(met.select("b1", "b2", F.when(F.col("b1") == F.col("b2"), _FIRST).otherwise(_SECOND).alias("what"), F.col("second").alias("lead"), F.col("b2").alias("block"))).distinct()
    sent = sides.join(placed, ["lead", "block"]).select("b1", "b2", "what", F.col("lead").alias("first"), "id")

    again = rows.join(own.where("copies > 1").select("s", "h", F.col("id").alias("first")), ["s", "h"]).where(F.col("id") != F.col("first"))
    bucket = F.struct(F.col("first").alias("label"), F.pmod(F.xxhash64("id"), F.lit(COPY_GROUPS)).alias("sub"), F.lit(-1).cast("long").alias("part"))
    sent = sent.unionByName(again.select(bucket.alias("b1"), bucket.alias("b2"), F.lit(_COPY).alias("what"), "first", "id"))
    texts = read.join(sent, "id").select("b1", "b2", "what", "first", F.col("id").alias("second"), "text")
    asked = texts.unionByName(met.select("b1", "b2", F.lit(_LINK).alias("what"), "first", "second", F.lit(None).cast("string").alias("text")))
    name = kind.simpleString()
    return asked.groupBy("b1", "b2").applyInArrow(_mark(to_arrow_type(kind)), f"first {name}, second {name}, first_html string, second_html string, differences int")


def record(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links after a scan: unseen pairs added as pending, scores of pending ones refreshed, ruled ones left alone."""
    p = pairs.select(F.col("first").alias("pf"), F.col("second").alias("ps"), F.col("score").alias("pscore"), F.col("matched_on").alias("pmatched"))
    joined = links.join(p, (links["first"] == p["pf"]) & (links["second"] == p["ps"]), "full_outer")
    fresh = F.col("pscore").isNotNull() & (F.col("state").isNull() | (F.col("state") == "pending"))
    return joined.select(
        F.coalesce("first", "pf").alias("first"), F.coalesce("second", "ps").alias("second"), F.when(fresh, F.col("pscore")).otherwise(F.col("score")).alias("score"),
        F.when(fresh, F.col("pmatched")).otherwise(F.col("matched_on")).alias("matched_on"), F.coalesce("state", F.lit("pending")).alias("state"),
    )


@dataclass
class Library:
    """The tables that a ruling changes."""

    works: DataFrame  # id, review_state, reviewed_at, replaced_by_id, collection_id, collection_position
    favourites: DataFrame  # user_id, work_id, created_at
    history: DataFrame  # user_id, work_id, last_read_at, read_count
    media: DataFrame  # id, work_id, video_id
    tags: DataFrame  # work_id, tag_id
    links: DataFrame  # first, second, state, kept_id, kept_was, hidden_was


def move_reader_rows(rows: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of hidden works given to the kept ones; a reader who has the kept work already keeps that row."""
    m = moves.select(F.col("hidden").alias("_h"), F.col("kept").alias("_k"))
    moved = rows.join(m, rows["work_id"] == m["_h"], "left").withColumn("_moved", F.col("_k").isNotNull()).withColumn("work_id", F.coalesce("_k", "work_id"))
    others = [c for c in rows.columns if c not in keys]
    best = moved.groupBy(*keys).agg(F.min(F.struct("_moved", *others)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def keep(library: Library, rulings: DataFrame, now: Column) -> Library:
    """Rulings (first, second, kept) on pending links: the other work is hidden and points to the kept one, which is
    approved; readers' rows, media, tags and the place in a collection go to the kept one. Prior states are noted.
    A link that is ruled on already does not change."""
    pending = library.links.where("state = 'pending'").select("first", "second")
    moves = rulings.join(pending, ["first", "second"], "left_semi").select("first", "second", F.col("kept"), F.when(F.col("kept") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("hidden"))
    w = library.works
    states = w.select(F.col("id").alias("_id"), F.col("review_state").alias("_state"))
    hidden = moves.select(F.col("hidden").alias("_h"), F.col("kept").alias("_k"))
    kept = moves.select(F.col("kept").alias("_kept")).distinct().withColumn("_is_kept", F.lit(True))
    place = w.join(hidden, w["id"] == hidden["_h"]).groupBy("_k").agg(F.max(F.struct("collection_id", "collection_position")).alias("_place")).withColumnRenamed("_k", "_pk")
    out = w.join(hidden, w["id"] == hidden["_h"], "left").join(kept, w["id"] == kept["_kept"], "left").join(place, w["id"] == place["_pk"], "left")
    chain = moves.select(F.col("hidden").alias("_ch"), F.col("kept").alias("_ck"))
    out = out.join(chain, out["replaced_by_id"] == chain["_ch"], "left")
    takes = F.col("_is_kept") & F.col("collection_id").isNull() & F.col("_place.collection_id").isNotNull()
    changed = {
        "review_state": F.when(F.col("_h").isNotNull(), "rejected").when(F.col("_is_kept"), "approved").otherwise(F.col("review_state")),
        "reviewed_at": F.when(F.col("_h").isNotNull() | F.col("_is_kept"), now).otherwise(F.col("reviewed_at")),
        "replaced_by_id": F.when(F.col("_h").isNotNull(), F.col("_k")).when(F.col("_is_kept"), F.lit(None)).otherwise(F.coalesce("_ck", "replaced_by_id")),
        "collection_id": F.when(takes, F.col("_place.collection_id")).otherwise(F.col("collection_id")),
        "collection_position": F.when(takes, F.col("_place.collection_position")).otherwise(F.col("collection_position")),
    }
    works = out.select(*[changed[c].alias(c) if c in changed else out[c] for c in w.columns])
    md = library.media
    have = md.join(moves.select(F.col("kept").alias("_kk")).distinct(), md["work_id"] == F.col("_kk"), "left_semi").select(F.col("work_id").alias("_kw"), F.col("video_id").alias("_kv"))
    go = md.join(hidden, md["work_id"] == hidden["_h"])
    go = go.join(have, (go["_k"] == have["_kw"]) & (go["video_id"] == have["_kv"]) & (go["video_id"] != ""), "left_anti").select("id", "video_id", F.col("_k").alias("_to"))
    media = md.join(go.select(F.col("id").alias("_mid"), "_to"), md["id"] == F.col("_mid"), "left").withColumn("work_id", F.coalesce("_to", "work_id")).select(*md.columns)
    tg = library.tags
    tags = tg.unionByName(tg.join(hidden, tg["work_id"] == hidden["_h"]).select(F.col("_k").alias("work_id"), "tag_id")).distinct()
    notes = moves.join(states.withColumnRenamed("_state", "kw"), moves["kept"] == F.col("_id")).drop("_id").join(states.withColumnRenamed("_state", "hw"), moves["hidden"] == F.col("_id")).drop("_id")
    notes = notes.select(F.col("first").alias("_f"), F.col("second").alias("_s"), F.col("kept").alias("_kept"), "kw", "hw")
    lk = library.links.join(notes, (F.col("first") == F.col("_f")) & (F.col("second") == F.col("_s")), "left")
    ruled = F.col("_kept").isNotNull()
    set_ = {"state": F.when(ruled, "duplicate").otherwise(F.col("state")), "kept_id": F.coalesce("_kept", "kept_id"), "kept_was": F.when(ruled, F.col("kw")).otherwise(F.col("kept_was")), "hidden_was": F.when(ruled, F.col("hw")).otherwise(F.col("hidden_was"))}
    links = lk.select(*[set_[c].alias(c) if c in set_ else F.col(c) for c in library.links.columns])
    return Library(works, move_reader_rows(library.favourites, moves, ["user_id", "work_id"]), move_reader_rows(library.history, moves, ["user_id", "work_id"]), media, tags, links)


def reopen(library: Library, pairs: DataFrame) -> Library:
    """Rulings taken back: the hidden and the kept work get their prior states, the link is pending again."""
    links = library.links
    ruled = links.where("state <> 'pending'").join(pairs, ["first", "second"], "left_semi")
    hidden = F.when(F.col("kept_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    back = ruled.where(F.col("kept_id").isNotNull()).select(hidden.alias("_id"), F.col("hidden_was").alias("_was"), F.lit(True).alias("_hidden"))
    back = back.unionByName(ruled.where(F.col("kept_id").isNotNull()).select(F.col("kept_id").alias("_id"), F.col("kept_was").alias("_was"), F.lit(False).alias("_hidden")))
    w = library.works.join(back, library.works["id"] == back["_id"], "left")
    changed = {"review_state": F.coalesce("_was", "review_state"), "replaced_by_id": F.when(F.col("_hidden"), F.lit(None)).otherwise(F.col("replaced_by_id"))}
    works = w.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in library.works.columns])
    mark = ruled.select(F.col("first").alias("_f"), F.col("second").alias("_s")).withColumn("_re", F.lit(True))
    lk = links.join(mark, (links["first"] == mark["_f"]) & (links["second"] == mark["_s"]), "left")
    blank = {"state": "pending", "kept_id": None, "kept_was": "", "hidden_was": ""}
    out = lk.select(*[F.when(F.col("_re"), F.lit(blank[c]).cast(links.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in blank else F.col(c) for c in links.columns])
    return Library(works, library.favourites, library.history, library.media, library.tags, out)


def keep_both(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pending links ruled distinct."""
    p = pairs.select(F.col("first").alias("_f"), F.col("second").alias("_s")).withColumn("_hit", F.lit(True))
    joined = links.join(p, (links["first"] == p["_f"]) & (links["second"] == p["_s"]), "left")
    return joined.withColumn("state", F.when(F.col("_hit") & (F.col("state") == "pending"), "distinct").otherwise(F.col("state"))).select(*links.columns)


def next_pending(links: DataFrame) -> DataFrame:
    return links.where("state = 'pending'").orderBy(F.desc("score"), F.desc_nulls_first("created_at"), "first", "second").limit(1)
