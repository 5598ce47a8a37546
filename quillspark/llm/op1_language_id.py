"""Language ID by prediction by partial matching.

Each language has a context tree over bytes: the contexts (up to `order` bytes) that its sample holds often
enough, with the counts of the bytes that follow. A byte that a context has seen gets c / (n + d) of its
probability (n: occurrences, d: different followers); d / (n + d) escapes to the next shorter context, shared
among the bytes this one has not seen; below the empty context stands a uniform law over 256 bytes. After
training the statistics are frozen, so the exact code length of a byte depends on its context only: the trees
of all languages are merged into one table (context, byte) -> bits for each language, and a text costs a few
array look-ups a byte.

Training takes a bounded sample (documented parameters): up to `sample_docs` texts for each language, chosen by a hash
of the key, and of a longer text a part of `sample_bytes` bytes from a place that the hash names; the `most_langs` most frequent
languages are learned, `Model.langs` says which. The trees keep at most `max_contexts` contexts in all, those that some language holds
the most often. Whole texts are scored, in blocks.

Very long texts cost no more a byte than short ones; columns with the results' names are replaced. Defined results: a text that is null, empty or without a letter gives `und` and score 0. Ties go to the first
language in order. Without any labelled row every text is `und`. Rows are neither dropped nor merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, fresh_name, in_arrow, small, table, typed, utf8

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Frozen statistics. bits[context * n_symbols + symbol] has a column for each language."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; bytes that no sample holds share one
    child: np.ndarray  # context * (n_symbols + 1) + older symbol -> longer context, or the dead one
    bits: np.ndarray
    n_symbols: int
    order: int
    dead: int


def train(samples: dict[str, list[bytes]], order: int = 4, max_contexts: int = 6000, min_count: int = 16) -> Model:
    """Context trees of every language, merged. samples: whole texts of each language."""
    langs = sorted(samples)
    used = sorted({b for texts in samples.values() for b in set(b"".join(texts))})
    symbol = np.zeros(256, np.int64)
    for i, b in enumerate(used):
        symbol[b] = i + 1
    n = len(used) + 1
    follow: list[dict[int, Counter]] = []  # for each language: packed context -> followers
    total: Counter = Counter()
    base = n + 1  # 0 ends a packed context
    for lang in langs:
        tree: dict[int, Counter] = {0: Counter()}
        texts = [t for t in samples[lang] if t]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.empty(0, np.int64)
        sym = symbol[raw]
        packed = np.zeros(len(raw), np.int64)
        for k in range(order + 1):
            if len(sym) <= k:
                break
            if k:
                packed = packed[1:] + (sym[: len(sym) - k] + 1) * base ** (k - 1)
            seen, counts = np.unique(packed[at[k:] >= k] * n + sym[k:][at[k:] >= k], return_counts=True)
            for key, c in zip(seen.tolist(), counts.tolist(), strict=True):
                ctx, s = divmod(key, n)
                tree.setdefault(ctx, Counter())[s] += c
        follow.append(tree)
        for ctx, c in tree.items():
            total[ctx] = max(total[ctx], sum(c.values()))

    def length(ctx: int) -> int:
        k = 0
        while ctx:
            ctx //= base
            k += 1
        return k

    ranked = sorted((c for c in total if c and total[c] >= min_count), key=lambda c: (-total[c], length(c), c))[: max_contexts - 1]
    kept = {0: 0}
    for ctx in sorted(ranked, key=length):
        if ctx % base ** max(length(ctx) - 1, 0) in kept:  # the context without its oldest byte
            kept[ctx] = len(kept)
    dead = len(kept)
    child = np.full((dead + 1) * (n + 1), dead, np.int32)
    for ctx, i in kept.items():
        if ctx:
            k = length(ctx)
            child[kept[ctx % base ** (k - 1)] * (n + 1) + ctx // base ** (k - 1) - 1] = i
    uniform = np.full(n, 1 / 256)
    uniform[0] = (256 - len(used)) / 256 if len(used) < 256 else 0.0
    bits = np.zeros((dead * n, len(langs)), np.float32)
    for j, tree in enumerate(follow):
        probs: dict[int, np.ndarray] = {}
        for ctx, i in kept.items():  # shorter contexts come first
            lower = probs[ctx % base ** (length(ctx) - 1)] if ctx else uniform
            probs[ctx] = p = escape(tree.get(ctx), lower)
            each = p.copy()
            each[0] /= max(256 - len(used), 1)
            bits[i * n : (i + 1) * n, j] = -np.log2(np.maximum(each, 1e-30))
    return Model(langs, symbol.astype(np.int32), child, np.ascontiguousarray(bits), n, order, dead)


def escape(counts: Counter | None, lower: np.ndarray) -> np.ndarray:
    """The law of a context from its counts and the law of the next shorter one."""
    if not counts:
        return lower
    c = np.zeros(len(lower))
    c[list(counts)] = list(counts.values())
    n, unseen = c.sum(), c == 0
    d = len(counts)
    rest = lower[unseen].sum()
    if rest <= 0:
        return c / n
    p = c / (n + d)
    p[unseen] = d / (n + d) * lower[unseen] / rest
    return p


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """Bits of each row under each language, as float64. Long texts go through in blocks."""
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, len(model.langs)))
    lo, hi, wide = int(offsets[0]), int(offsets[-1]), model.n_symbols + 1
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = offsets[:-1][filled]
    for a in range(lo, hi, block):
        b = min(a + block, hi)
        first = max(a - model.order, lo)
        sym = model.symbol[raw[first:b]]
        here = sym[a - first :]
        state = np.zeros(b - a, np.int32)
        cur = np.zeros(b - a, np.int32)
        inside = starts[(starts > a - model.order) & (starts < b)]
        for k in range(1, model.order + 1):
            older = np.full(b - a, wide - 1, np.int32)
            skip = max(0, k - (a - first))
            older[skip:] = sym[a - first - k + skip : len(sym) - k]
            for e in range(k):
                p = inside + e - a
                older[p[(p >= 0) & (p < b - a)]] = wide - 1
            cur = model.child[cur * wide + older]
            state = np.where(cur != model.dead, cur, state)
        cost = model.bits[state * model.n_symbols + here]
        r0 = int(np.searchsorted(starts, a, side="right")) - 1
        r1 = int(np.searchsorted(starts, b, side="left"))
        cuts = np.maximum(starts[r0:r1], a) - a
        out[filled[r0:r1]] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
    return out


def judge(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: und), its posterior, and bits a byte, of each text."""
    raw, offsets, valid = utf8(column)
    n = len(valid)
    size = np.diff(offsets)
    lang, score, rate = np.full(n, -1), np.zeros(n), np.zeros(n)
    if not n or not model.langs:
        return lang, score, rate
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    has = np.zeros(n, bool)
    filled = np.flatnonzero(size > 0)
    if len(filled):
        lo = int(offsets[0])
        plain = np.logical_or.reduceat(letter[raw[lo : int(offsets[-1])]], offsets[:-1][filled] - lo)
        has[filled] = plain
        for i in filled[~plain]:
            has[i] = bool(_LETTER.search(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    cost = code_lengths(model, raw, offsets)
    best = cost.argmin(axis=1)
    post = 1 / np.exp2(np.minimum(cost.min(axis=1)[:, None] - cost, 0)).sum(axis=1)
    lang[has] = best[has]
    score[has] = np.clip(post[has], 0, 1)
    rate[has] = cost.min(axis=1)[has] / size[has]
    return lang, score, rate


def sample_texts(docs: DataFrame, keep: F.Column, sample_docs: int = 300, sample_bytes: int = 16_384, most_langs: int = 400, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[bytes]]:
    """Up to sample_docs texts of each language among the rows that `keep` holds for, by the order of a hash of the key; of a
    longer text, a part of about sample_bytes bytes.

    A first pass counts each language, a second one takes rows whose hash is below a threshold set by that count,
    so no more than about 1.5 * sample_docs texts of a language reach the driver, at any size of input.
    """
    t = F.col(text).cast("string")
    rows = docs.where(keep & F.col(lang).isNotNull() & t.rlike(r"\p{L}")).select(F.col(key).alias("k"), t.alias("t"), F.col(lang).alias("g"))
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(most_langs).collect()}
    if not counts:
        return {}
    slots = 1 << 24
    hashed = F.pmod(F.xxhash64("k"), F.lit(slots))
    bound = F.try_element_at(F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(slots, 1 + int(slots * 1.5 * (sample_docs + 20) / n)))]), F.col("g"))
    spare = F.greatest(F.length("t") - sample_bytes, F.lit(0))
    part = F.when(F.octet_length("t") <= sample_bytes, F.col("t")).otherwise(F.substring("t", (F.pmod(F.xxhash64("k", F.lit(5)), spare + 1) + 1).cast("int"), F.lit(sample_bytes)))
    found = rows.where(hashed < bound).select("g", part.alias("t"), F.xxhash64("k").alias("h")).collect()
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["g"], r["h"], r["t"])):
        texts = out.setdefault(r["g"], [])
        if len(texts) < sample_docs:
            texts.append(r["t"].encode()[:sample_bytes])
    return out


def held_out(key: str = "doc_id") -> F.Column:
    """Rows kept from training: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, **sampling) -> Model:
    """A model from the rows that are not held out."""
    known = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    return train(sample_texts(docs, known, **sampling))


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """df with the predicted language, its posterior and the bits a byte. Columns that have these names are replaced."""
    df = df.drop(*names)
    schema = typed(df, *zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        codes = np.array([*m.langs, "und"], object)
        for batch in small(batches, at):
            lang, score, rate = judge(m, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes[lang], pa.string()), pa.array(score), pa.array(rate)], names=[*batch.schema.names, *names])

    return in_arrow(df, run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.round("bits_per_byte", 4).alias("bits_per_byte"))


#: Bits a byte above which a text is like no learned language.
REJECT_BITS = 7.0


def keep_identified(docs: DataFrame, reject_bits: float = REJECT_BITS) -> DataFrame:
    """docs without the rows that have no letter or are like no learned language."""
    if "lang" not in docs.columns:
        raise ValueError("a lang column is needed to learn from")
    names = tuple(fresh_name(docs, x) for x in ("lang_pred", "score", "bits_per_byte"))
    marked = identify(docs, fit(docs), names=names)
    return marked.where((F.col(names[0]) != "und") & (F.col(names[2]) <= reject_bits)).select(*docs.columns)
