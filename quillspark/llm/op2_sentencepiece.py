"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public vocabulary that match a text form a lattice. A forward pass sums, for every position,
the weight of all segmentations that end there; a backward pass then draws one segmentation with exactly its
share of the total weight. The draws come from a hash of the row key, so a row has the same segmentation on any
cluster, in any order and after any retry. A merge-rank vocabulary holds no probabilities: a piece of rank r gets
weight (r + 10) ** -theta; a vocabulary of log-probabilities uses exp(theta * score). Characters without a
piece fall back to their bytes.

No piece of the vocabulary crosses from a word into the space after it, so the lattice falls apart at spaces, and one
word's lattice serves all its occurrences; a worker keeps a bounded number of them. Lattices of many words are built,
and many words sampled, in lockstep with array operations. A long run without a space falls apart too, at the places
that no piece crosses. What is left of thousands of characters is filtered forward in blocks that carry the last sums,
and sampled backward in the same blocks, so no segmentation is lost anywhere and memory stays bounded.

Spaces stand for the vocabulary's space mark and a text gets one in front, so decoding joins the bytes of the
pieces and drops that space; a space mark that the text itself holds goes as bytes. Decoding returns the exact
text. Defined results: a null text has null pieces, an empty one has none; a null key counts as a fixed key, a key
that is no whole number goes by a hash; repeated rows are encoded alike; a column that has the name of a result of
`encode` or `decode` is replaced, `round_trip` takes names that are free.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fresh_name, in_arrow, long_id, mix64, small, table, typed, utf8

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Ids from here on stand for a character that goes as bytes, until the pieces are laid out.
CHARACTER = 1 << 24
#: Runs of more characters are taken apart where no piece crosses, into segments of at least SHORT_RUN characters.
LONG_RUN, SHORT_RUN = 512, 32
#: Segments of more characters are not kept as lattices, but filtered and sampled in blocks of so many characters.
LONG_SEGMENT, LONG_BLOCK = 4096, 16_384
#: Characters whose lattices are built at once, and that are sampled at once.
BUILT, SAMPLED = 200_000, 1 << 19
_SEGMENT = re.compile(r" *[^ ]+| +")
_U = np.uint64


@dataclass
class Vocabulary:
    """Tables of the vocabulary, made on the driver and sent to the executors; their size is the vocabulary's."""

    symbol: np.ndarray  # code point -> symbol, 0: in no piece
    keys: np.ndarray  # hash table of (node, symbol)
    nodes: np.ndarray
    n_symbols: int
    piece: np.ndarray  # node -> piece or -1
    weight: np.ndarray  # piece -> log weight
    single: np.ndarray  # symbol -> whether it is a piece of its own
    longest: int
    byte_piece: np.ndarray
    byte_weight: float
    starts: np.ndarray  # of the bytes of each piece
    lens: np.ndarray
    raw: np.ndarray


def load_vocabulary(path: str = MODEL_PATH, theta: float = 1.0) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts, surfaces, scores, byte_piece = {}, [], np.zeros(n), np.full(256, -1, np.int64)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_piece[int(p[3:5], 16)] = i
            surfaces.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surfaces.append(b"")
        else:
            texts[p.replace(SPACE, " ")] = i
            surfaces.append(p.replace(SPACE, " ").encode())
            scores[i] = sp.get_score(i)
    if (byte_piece < 0).any() or any(re.search(r"[^ ] ", t, re.S) for t in texts):
        raise ValueError("the vocabulary needs byte pieces, and no piece that goes on over a space")
    ranks = all(float(s).is_integer() and s <= 0 for s in scores[list(texts.values())])
    weight = theta * (-np.log(10 - scores) if ranks else scores)
    symbols = {c: k + 1 for k, c in enumerate(sorted({c for t in texts for c in t}))}
    symbol = np.zeros(0x110000, np.int32)
    for c, k in symbols.items():
        symbol[ord(c)] = k
    edges: dict[tuple[int, int], int] = {}
    piece = [-1]
    for t, i in texts.items():
        node = 0
        for c in t:
            if (step := (node, symbols[c])) not in edges:
                edges[step] = len(piece)
                piece.append(-1)
            node = edges[step]
        piece[node] = i
    width = len(symbols) + 1
    slots = 1 << int(np.ceil(np.log2(len(edges) * 6)))
    keys, nodes = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
    for (node, s), child in edges.items():
        key = node * width + s
        at = _slot(np.array([key]), slots)[0]
        while keys[at] >= 0:
            at = (at + 1) % slots
        keys[at], nodes[at] = key, child
    single = np.zeros(width, bool)
    for t in texts:
        if len(t) == 1:
            single[symbols[t]] = True
    lens = np.array([len(s) for s in surfaces])
    return Vocabulary(
        symbol, keys, nodes, width, np.array(piece), weight, single, max(map(len, texts)), byte_piece, theta * -np.log(n + 10.0),
        np.concatenate(([0], np.cumsum(lens)[:-1])), lens, np.frombuffer(b"".join(surfaces), np.uint8),
    )


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - slots.bit_length() + 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _utf8_bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


class _Index(dict):
    """Numbers words as they come; keeps the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _name(run: str) -> str:
    """The name of a run of text: a word's is its text without the space before it, another's two spaces and the run."""
    return run[1:] if len(run) > 1 and run[0] == " " and " " not in run[1:2] else "  " + run


class Lattices:
    """Sampling tables of the words seen so far: for each node (a position in a word), its incoming edges.

    A word is named by its text without the space before it; other runs of text by two spaces and the run.
    """

    def __init__(self, vocabulary: Vocabulary, most_edges: int = 3_000_000):
        self.v, self.most = vocabulary, most_edges
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.base, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int32)
        self.upto, self.step, self.piece = np.zeros(0, np.float32), np.zeros(0, np.uint8), np.zeros(0, np.int32)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.upto) > self.most:
            self.clear()
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new, self.index.new = self.index.new, []
        upto = np.cumsum([len(w) for w in new]) // BUILT if new else np.empty(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(new)]
        parts = [self._build(new[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if parts:
            nodes, edges = len(self.first), len(self.upto)
            for p in parts:
                p["base"] += nodes
                p["first"] += edges
                nodes, edges = nodes + len(p["first"]), edges + len(p["upto"])
            for name in parts[0]:
                setattr(self, name, np.concatenate([getattr(self, name), *(p[name] for p in parts)]))
        return found

    def _edges(self, symbol: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character, length and id of every piece that matches, by walking the trie from all characters at once."""
        v, found = self.v, []
        at, node = np.arange(len(symbol), dtype=np.int32), np.zeros(len(symbol), np.int64)
        for k in range(1, v.longest + 1):
            if k > 1:
                keep = left[at] >= k
                at, node = at[keep], node[keep]
            if not len(at):
                break
            key = node * v.n_symbols + symbol[at + (k - 1)]
            slot = _slot(key, len(v.keys))
            held = v.keys[slot]
            odd = np.flatnonzero((held != key) & (held >= 0))
            while len(odd):
                slot[odd] = (slot[odd] + 1) & (len(v.keys) - 1)
                held[odd] = v.keys[slot[odd]]
                odd = odd[(held[odd] != key[odd]) & (held[odd] >= 0)]
            keep = held >= 0
            at, node = at[keep], v.nodes[slot[keep]].astype(np.int64)
            ends = v.piece[node]
            done = ends >= 0
            found.append((at[done], np.full(int(done.sum()), k, np.int32), ends[done]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def segments(self, text: str) -> list[str]:
        """Names of the runs that the lattice of a text falls apart into."""
        words = text.split(" ")
        if "" not in words and max(map(len, words)) <= LONG_RUN:
            return words
        out: list[str] = []
        for run in _SEGMENT.findall(" " + text):
            if len(run) <= LONG_RUN:
                out.append(_name(run))
            else:
                cuts = self._cuts(run)
                out += [_name(run[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _cuts(self, run: str) -> list[int]:
        """Places that no piece crosses, at least SHORT_RUN apart, with both ends of the run."""
        v, n = self.v, len(run)
        crossed = np.zeros(n + 1, np.int32)
        for a in range(0, n, LONG_BLOCK):
            code = _codes(run[a : a + LONG_BLOCK + v.longest])
            at, length, _ = self._edges(v.symbol[code], len(code) - np.arange(len(code)))
            own = (at < LONG_BLOCK) & (length > 1)
            np.add.at(crossed, a + at[own] + 1, 1)
            np.add.at(crossed, a + at[own] + length[own], -1)
        out = [0]
        for c in np.flatnonzero(np.cumsum(crossed) == 0).tolist():
            if c - out[-1] >= SHORT_RUN and n - c >= SHORT_RUN:
                out.append(c)
        return [*out, n]

    def _ending(self, run: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, length, piece, weight) of the edges that end in a + 1 to b, the longest first; first has b - a + 1 entries."""
        v = self.v
        lo = max(0, a - v.longest + 1)
        code = _codes(run[lo:b])
        symbol = v.symbol[code]
        at, length, piece = self._edges(symbol, len(code) - np.arange(len(code)))
        alone = np.flatnonzero(~v.single[symbol])
        weight = np.concatenate((v.weight[piece], v.byte_weight * _utf8_bytes(code[alone])))
        at, length, piece = np.concatenate((at, alone)), np.concatenate((length, np.ones(len(alone), np.int32))), np.concatenate((piece, CHARACTER + code[alone].astype(np.int64)))
        end = lo + at + length
        own = np.flatnonzero(end > a)
        own = own[np.lexsort((-length[own], end[own]))]
        return np.searchsorted(end[own], np.arange(a + 1, b + 2)), length[own], piece[own], weight[own]

    def sample_long(self, run: str, seed: np.ndarray) -> np.ndarray:
        """Pieces of one run, drawn as `sample` draws them; only a sum for each character is kept for all of it."""
        n = len(run)
        total = np.zeros(n + 1)
        for a in range(0, n, LONG_BLOCK):
            b = min(a + LONG_BLOCK, n)
            first, length, _, weight = self._ending(run, a, b)
            lo = max(0, a - self.v.longest)
            sums, first, back, weight = total[lo : a + 1].tolist(), first.tolist(), length.tolist(), weight.tolist()
            for e in range(b - a):
                here = len(sums)
                ways = [weight[k] + sums[here - back[k]] for k in range(first[e], first[e + 1])]
                top = max(ways)
                sums.append(top if len(ways) == 1 else top + math.log(sum(math.exp(w - top) for w in ways)))
            total[a + 1 : b + 1] = sums[a + 1 - lo :]
        out: list[int] = []
        pos, b = n, n
        while pos:
            a = max(0, b - LONG_BLOCK)
            first, length, piece, weight = self._ending(run, a, b)
            places = np.arange(a + 1, b + 1)
            share = np.exp(weight + total[np.repeat(places, np.diff(first)) - length] - np.repeat(total[places], np.diff(first)))
            u = (mix64(seed + places.astype(_U) * _U(0xBF58476D1CE4E5B9)) >> _U(40)).astype(np.float64) * 2.0**-24
            first, length, piece, share, u = first.tolist(), length.tolist(), piece.tolist(), share.tolist(), u.tolist()
            while pos > a:
                k, end, left = first[pos - a - 1], first[pos - a] - 1, u[pos - a - 1]
                while k < end and share[k] <= left:
                    left -= share[k]
                    k += 1
                out.append(piece[k])
                pos -= length[k]
            b = pos
        return np.array(out[::-1], np.int32)

    def _build(self, names: list[str]) -> dict[str, np.ndarray]:
        v = self.v
        words = [w[2:] if w[:2] == "  " else " " + w for w in names]
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        code = _codes("".join(words))
        n = len(code)
        symbol = v.symbol[code]
        place = np.arange(n) - np.repeat(start, size)
        at, length, piece = self._edges(symbol, np.repeat(size, size) - place)
        alone = np.flatnonzero(~v.single[symbol])
        weight = np.concatenate((v.weight[piece], v.byte_weight * _utf8_bytes(code[alone])))
        at, length, piece = np.concatenate((at, alone)), np.concatenate((length, np.ones(len(alone), np.int32))), np.concatenate((piece, CHARACTER + code[alone].astype(np.int64)))
        node = at + length - 1
        order = np.argsort((place[node] << 40) | (node.astype(np.int64) << 8) | (255 - length))  # by place in the word, then node, the longest first
        node, length, piece, weight = node[order], length[order], piece[order], weight[order]
        head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        group = np.repeat(np.arange(len(head)), np.diff(np.concatenate((head, [len(node)]))))
        total = np.zeros(n + 1)  # the last one: before any word
        prior = np.where(length > place[node], n, node - length)
        cuts = np.searchsorted(place[node[head]], np.arange(int(size.max()) + 1))
        for e in range(int(size.max())):  # all words' e-th nodes
            g0, g1 = cuts[e], cuts[e + 1]
            lo, hi = head[g0], head[g1] if g1 < len(head) else len(node)
            w = weight[lo:hi] + total[prior[lo:hi]]
            own, top = group[lo:hi] - g0, np.maximum.reduceat(w, head[g0:g1] - lo)
            sums = np.add.reduceat(np.exp(w - top[own]), head[g0:g1] - lo)
            total[node[head[g0:g1]]] = top + np.log(sums)
            weight[lo:hi] = w
        share = np.exp(weight - total[node])
        upto = np.cumsum(share)
        upto -= (upto[head] - share[head])[group]
        upto[np.concatenate((head[1:], [len(node)])) - 1] = 2.0
        first = np.empty(n, np.int32)
        first[node[head]] = head
        return {"base": start, "size": size.astype(np.int32), "first": first, "upto": upto.astype(np.float32), "step": length.astype(np.uint8), "piece": piece.astype(np.int32)}

    def sample(self, word: np.ndarray, row_key: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words in order, and how many each word has. ordinal: the word's place in its row."""
        seed = mix64(row_key.astype(_U) + ordinal.astype(_U) * _U(0x9E3779B97F4A7C15))
        occ, pos, base = np.arange(len(word)), self.size[word].astype(np.int64), self.base[word]
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(word), np.int64)
        while len(occ):
            edge = self.first[base + pos - 1].astype(np.int64)
            u = (mix64(seed + pos.astype(_U) * _U(0xBF58476D1CE4E5B9)) >> _U(40)).astype(np.float32) * np.float32(2**-24)
            miss = np.flatnonzero(self.upto[edge] <= u)
            while len(miss):
                edge[miss] += 1
                miss = miss[self.upto[edge[miss]] <= u[miss]]
            drawn.append((occ, self.piece[edge]))
            count[occ] += 1
            pos = pos - self.step[edge]
            more = pos > 0
            occ, pos, base, seed = occ[more], pos[more], base[more], seed[more]
        out, end = np.zeros(int(count.sum()), np.int32), np.cumsum(count)
        for k, (occ, pieces) in enumerate(drawn):
            out[end[occ] - 1 - k] = pieces
        return out, count


def lay_out(v: Vocabulary, pieces: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put byte pieces where a character goes as bytes."""
    far = np.flatnonzero(pieces >= CHARACTER)
    if not len(far):
        return pieces, offsets
    as_bytes = [chr(p - CHARACTER).encode("utf-8", "surrogatepass") for p in pieces[far].tolist()]
    width = np.ones(len(pieces), np.int64)
    width[far] = [len(b) for b in as_bytes]
    ends = np.concatenate(([0], np.cumsum(width)))
    out = np.repeat(pieces, width)
    flat = np.frombuffer(b"".join(as_bytes), np.uint8)
    where = np.repeat(ends[far], width[far]) + np.arange(len(flat)) - np.repeat(np.cumsum(width[far]) - width[far], width[far])
    out[where] = v.byte_piece[flat]
    return out.astype(np.int32), ends[offsets]


def _sampled(lattices: Lattices, words: list[str], row_key: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the words in order, and how many each word has; a bounded number of characters at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    long = size > LONG_SEGMENT
    turn = np.cumsum(size) // SAMPLED + 2 * len(words) * np.cumsum(long | np.concatenate(([False], long[:-1])))
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(words)]
    pieces, counts = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a == 1 and long[a]:
            seed = mix64(row_key[a:b].astype(_U) + ordinal[a:b].astype(_U) * _U(0x9E3779B97F4A7C15))
            run = words[a][2:] if words[a][:2] == "  " else " " + words[a]
            pieces.append(lattices.sample_long(run, seed))
            counts.append(np.array([len(pieces[-1])]))
        elif b > a:
            found, n = lattices.sample(lattices.lookup(words[a:b]), row_key[a:b], ordinal[a:b])
            pieces.append(found)
            counts.append(n)
    return np.concatenate(pieces), np.concatenate(counts)


def encode_column(lattices: Lattices, text: pa.Array, keys: np.ndarray, seed: int) -> pa.Array:
    raw, offsets, valid = utf8(text)
    values, counts = [], np.zeros(len(valid), np.int64)
    keyed = mix64(keys.astype(_U) ^ _U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    for a, b in blocks(offsets):
        words: list[str] = []
        per_row = np.zeros(b - a, np.int64)
        for r in range(a, b):
            if offsets[r + 1] > offsets[r]:
                found = lattices.segments(raw[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "surrogatepass"))
                per_row[r - a] = len(found)
                words += found
        if not words:
            continue
        first = np.cumsum(per_row) - per_row
        ordinal = np.arange(len(words)) - np.repeat(first, per_row)
        pieces, n = _sampled(lattices, words, np.repeat(keyed[a:b], per_row), ordinal)
        ends = np.concatenate(([0], np.cumsum(n)))
        bounds = ends[np.concatenate((first, [len(words)]))]
        pieces, bounds = lay_out(lattices.v, pieces, bounds)
        values.append(pieces)
        counts[a:b] = np.diff(bounds)
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=mask)


def decode_column(v: Vocabulary, pieces: pa.ListArray) -> pa.Array:
    valid = np.asarray(pieces.is_valid())
    ends = np.asarray(pieces.offsets).astype(np.int64)
    ids = np.asarray(pieces.values)
    out, sizes = [], np.zeros(len(valid), np.int64)
    for a, b in blocks(ends, 1 << 18):
        own = ids[ends[a] : ends[b]]
        lens = v.lens[own]
        upto = np.concatenate(([0], np.cumsum(lens)))
        text = v.raw[np.repeat(v.starts[own] - upto[:-1], lens) + np.arange(upto[-1])]
        bound = upto[ends[a : b + 1] - ends[a]]
        lead = bound[:-1][np.diff(bound) > 0]
        lead = lead[text[lead] == 0x20]
        size = np.diff(bound)
        size[np.searchsorted(bound, lead, side="right") - 1] -= 1
        text = np.delete(text, lead)
        try:
            text.tobytes().decode()
        except UnicodeDecodeError:  # not a whole encoding; what can't be read is replaced
            cuts = np.concatenate(([0], np.cumsum(size)))
            rows = [text[x:y].tobytes().decode("utf-8", "replace").encode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            text, size = np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows])
        out.append(text)
        sizes[a:b] = size
    data = np.concatenate(out) if out else np.empty(0, np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()), bits)


_KEPT: dict[str, Lattices] = {}


def _lattices(shared) -> Lattices:
    """The worker's own lattices of a vocabulary, kept between tasks; bounded."""
    key = str(shared.value[0])
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Lattices(shared.value[1])
    return _KEPT[key]


def encode(df: DataFrame, path: str = MODEL_PATH, theta: float = 1.0, seed: int = 1, key: str = "doc_id", text: str = "text", out: str = "piece_ids") -> DataFrame:
    """df with the sampled pieces of each text. theta: 0 makes all segmentations alike, a large value the best one certain."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast((f"{path} {theta}", load_vocabulary(path, theta)))
    at, at_key = df.columns.index(text), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(shared)
        for batch in small(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, encode_column(lattices, batch.column(at), long_id(batch.column(at_key)), seed)], names=[*batch.schema.names, out])

    return in_arrow(df, run, typed(df, (out, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, path: str = MODEL_PATH, pieces: str = "piece_ids", out: str = "decoded_text") -> DataFrame:
    """df with the text of each array of pieces; null for null."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    at = df.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_column(shared.value, batch.column(at))], names=[*batch.schema.names, out])

    return in_arrow(df, run, typed(df, (out, T.StringType())))


def round_trip(docs: DataFrame, path: str = MODEL_PATH, theta: float = 1.0, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with piece_ids and decoded_text under names that are free, in this order, at the end; both in one pass."""
    ids, back = fresh_name(docs, "piece_ids"), fresh_name(docs, "decoded_text")
    shared = docs.sparkSession.sparkContext.broadcast((f"{path} {theta}", load_vocabulary(path, theta)))
    at, at_key = docs.columns.index(text), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(shared)
        for batch in small(batches, at):
            pieces = encode_column(lattices, batch.column(at), long_id(batch.column(at_key)), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces, decode_column(lattices.v, pieces)], names=[*batch.schema.names, ids, back])

    return in_arrow(docs, run, typed(docs, (ids, T.ArrayType(T.IntegerType())), (back, T.StringType())))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), F.sha2("decoded_text", 256).alias("decoded_sha256"), F.col("decoded_text").eqNullSafe(F.col("text")).alias("lossless"))
