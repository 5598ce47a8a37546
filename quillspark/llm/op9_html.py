"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element and each run of text is a node with a hidden state, content or not. A node's own potential comes
from its tag, its class, id and role words, and, for text, its size, links and punctuation; a parent-child potential,
by the kind of child, ties a node to its parent. Sum-product messages pass up and down each tree and give every
node's exact marginal; text with a content marginal of at least one half is kept. All trees of a batch pass their
messages together, a depth at a time.

Weights come from labelled pages by maximum likelihood, whose gradient takes the same marginals. The tables hold no page labels, so the labelled
pages are drawn here by a generator of page layouts that knows what it wrote as the article; their number is a
parameter. Scripts, styles, markup and form controls never become text.

A block is a run of text between block boundaries; line breaks and inline elements, formulas among them, do not end
one. Character references are decoded, white space becomes one space, blocks are joined by an empty line. Scripts,
styles, the page's title and form controls are dropped by rule, all else is left to the model: hidden elements,
fallback content and pictures are nodes with features like the others.

Pages are read once, forward: a tag that nothing closes is text, a quote that nothing closes is none, and elements
nested deeper than 512 become children of the one at that depth, as in browsers. So a broken page costs what a whole
one does. Defined results: null or empty html gives an empty text; unclosed or stray tags are closed or skipped as
browsers do for common elements; repeated rows each come back; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, small, table, typed

INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img picture source center "
    "math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mpadded mphantom menclose merror"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it ends at their end tag only, and is no text of the page.
RAW = frozenset("script style textarea title".split())
#: Form controls, whose text is no text of the page.
SILENT = frozenset("select option optgroup datalist button".split())
#: Opening one of these closes the open ones named, up to the nearest of the last set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
DEEPEST = 512
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag without angles in its quotes; it ends at the next angle, matched or not.
_PLAIN = re.compile(r"(?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+>")
_STEP = re.compile(r"[^>=]*+(?:(>)|=\s*+([\"'])?)")
_ATTR = re.compile(r"([^\s/=>\"'][^\s/=>]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")
_NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of class, id and role names, by what they speak of.
NAMES = {
    "menu": "nav navigation menu breadcrumb breadcrumbs toolbar pagination pager topics tags skip", "head": "header masthead banner logo brand topbar site",
    "foot": "footer copyright colophon contentinfo legal bottom imprint", "side": "sidebar aside side rail widget related recommended recommend more complementary trending popular",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion dfp outbrain taboola", "notice": "cookie cookies consent notice newsletter subscribe subscription popup modal alert overlay gdpr signup login paywall disclaimer",
    "talk": "comment comments reply replies respond disqus discussion reader responses", "share": "share sharing social follow tweet", "form": "form search input field",
    "main": "content article post entry body main story text page prose copy",
}
_NAMED = {w: k for k, ws in NAMES.items() for w in ws.split()}


@dataclass
class Tree:
    """Nodes of a page in page order: parent (-1 at the top), depth, features, and the text of leaves."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    features: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, features: tuple[str, ...], text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1


@lru_cache(256)
def _shared(size: int, links: int, sentence: bool, owner: bool) -> tuple[str, ...]:
    """Nodes with the same features share them: a page of very many nodes makes few objects."""
    return ("text", f"size{size}", f"links{links}", *["sentence"] * sentence, *["owner"] * owner)


@lru_cache(256)
def _plain(tag: str) -> tuple[str, ...]:
    return (f"<{tag}>",)


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n, words = len(text), text.count(" ") + 1
    return _shared(min(6, words.bit_length()), min(3, (4 * linked) // max(n, 1)), text[-1] in ".!?…\"”»。", "©" in text or "copyright" in text.lower())


def tag_features(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of an element: its tag, what its class, id and role speak of, and whether it says that it is hidden."""
    out = _plain(tag)
    if "=" not in attrs and "hidden" not in attrs.lower():
        return out
    names, hidden = set(), False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role"):
            names |= {f"name:{_NAMED[w]}" for w in (x.lower() for x in _WORD.findall(value)) if w in _NAMED}
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE_SHOWN.search(value):
            hidden = True
    return (*out, *sorted(names), *["hidden"] * hidden)


class _Scanner:
    """Reads a page's tags forward; never goes back over what it has read to the end without result."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()  # quotes that do not come again
        self.quoted = True  # whether quotes count; not after a tag of which all ends are within quotes

    def tag_end(self, at: int) -> int:
        """The place after the tag whose attributes begin at `at`; -1: nothing closes it."""
        m = _PLAIN.match(self.page, at)
        if m:
            return m.end()
        begin = at
        while self.quoted:
            m = _STEP.match(self.page, at)
            if not m:
                self.quoted = False
            elif m[1]:
                return m.end()
            else:
                at = m.end()
                if m[2] and m[2] not in self.unclosed:
                    close = self.page.find(m[2], at)
                    if close < 0:
                        self.unclosed.add(m[2])
                    else:
                        at = close + 1
        return self.page.find(">", begin) + 1 or -1


def parse(page: str) -> Tree:
    """The tree of block elements and runs of text."""
    tree = Tree()
    stack = [(-1, "root", False)]  # node, tag, whether silent; the page itself is no node: it holds the article and all around it
    places: dict[str, list[int]] = {}  # of each tag in the stack
    run: list[str] = []
    linked = inside_link = silent = 0

    def flush() -> None:
        nonlocal linked, inside_link
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                tree.add(stack[-1][0], text_features(text, linked), text)
        linked, inside_link = 0, 0

    def put(text: str) -> None:
        nonlocal linked
        if not silent:
            run.append(text)
            if inside_link:
                linked += len(text)

    def push(node: int, tag: str, quiet: bool) -> None:
        nonlocal silent
        silent += quiet
        places.setdefault(tag, []).append(len(stack))
        stack.append((node, tag, quiet))

    def close(to: int) -> None:
        """Take elements off the stack until it has `to`."""
        nonlocal silent
        while len(stack) > to:
            _, tag, quiet = stack.pop()
            places[tag].pop()
            silent -= quiet

    scanner, at, n = _Scanner(page), 0, len(page)
    ends = page.rfind(">")  # no tag ends after it
    while at < n:
        left = page.find("<", at)
        if left < 0 or left > ends:
            break
        if left > at:
            put(page[at:left])
        at = left
        follow = page[at + 1 : at + 2]
        if follow in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 2) if comment else page.find(">", at)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = follow == "/"
        m = _NAME.match(page, at + 1 + closing)
        end = scanner.tag_end(m.end()) if m else -1
        if end < 0:
            put("<")
            at += 1
            continue
        tag, attrs, at = m[0].lower(), page[m.end() : end - 1], end
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                m = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = m.end() if m else n
            continue
        if tag in INLINE:
            if tag == "a":
                inside_link = 0 if closing else 1
            elif tag in ("br", "img"):
                put(" ")
            continue
        if closing:
            if places.get(tag):
                to = places[tag][-1]
                if stack[to][2]:
                    close(to)
                else:
                    flush()
                    close(to)
            elif tag not in VOID and tag not in SILENT:
                flush()
            continue
        if tag in SILENT:
            if not attrs.endswith("/"):
                push(stack[-1][0], tag, True)
            continue
        flush()
        if tag in ("html", "body", "head"):
            continue
        if stack[-1][1] == "p":
            close(len(stack) - 1)
        closes, within = IMPLIED.get(tag, ((), ()))
        if closes:
            floor = max((places[w][-1] for w in within if places.get(w)), default=0)
            own = [x[i] for c in closes if (x := places.get(c)) and (i := bisect_right(x, floor)) < len(x)]
            if own:
                close(min(own))
        if tag in VOID:
            continue
        above = stack[-1][0]
        if above >= 0 and tree.depth[above] >= DEEPEST:
            above = tree.parent[above]
        push(tree.add(above, tag_features(tag, attrs)), tag, False)
    if at < n:
        put(page[at:])
    flush()
    return tree


@dataclass
class Weights:
    """own: feature -> log-odds of content; pair: for element and text children, log potentials by parent's and child's state."""

    own: dict[str, float]
    pair: np.ndarray


def sum_product(parent: np.ndarray, depth: np.ndarray, leaf: np.ndarray, odds: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact content marginal of each node of a forest, and the joint marginal (parent's state, own state) of each node
    with a parent; messages go up and then down, a depth at a time."""
    n = len(parent)
    below = np.zeros((n, 2))  # a node's potential and what its children say
    below[:, 1] = odds
    up = np.zeros((n, 2))  # message of each node to its parent
    edge = pair[leaf.astype(np.int64)]  # node, parent's state, own state
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    for nodes in reversed(levels[1:]):
        up[nodes] = np.logaddexp.reduce(edge[nodes] + below[nodes][:, None, :], axis=2)
        np.add.at(below, parent[nodes], up[nodes])
    belief = below.copy()
    joint = np.zeros((n, 2, 2))
    for nodes in levels[1:]:
        above = (belief[parent[nodes]] - up[nodes])[:, :, None] + edge[nodes]
        belief[nodes] += np.logaddexp.reduce(above, axis=1)
        joint[nodes] = above + below[nodes][:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def keep(trees: list[Tree], weights: Weights) -> list[list[str]]:
    """The content blocks of each page."""
    sizes = [len(t.parent) for t in trees]
    first = np.cumsum([0, *sizes[:-1]]) if sizes else np.empty(0, np.int64)
    parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first, strict=True)]) if trees else np.empty(0, np.int64)
    depth = np.concatenate([np.array(t.depth) for t in trees]) if trees else np.empty(0, np.int64)
    leaf = np.array([x is not None for t in trees for x in t.text], bool)
    get = weights.own.get
    sums = {fs: sum(get(f, 0.0) for f in fs) for fs in {fs for t in trees for fs in t.features}}
    odds = np.array([sums[fs] for t in trees for fs in t.features], float)
    content = sum_product(parent, depth, leaf, odds, weights.pair)[0] >= 0.5
    out = []
    for t, f in zip(trees, first, strict=True):
        out.append([x for x, c in zip(t.text, content[f : f + len(t.text)].tolist(), strict=True) if c and x is not None])
    return out


def labelled_pages(n: int = 320, seed: int = 5, known: float = 1.0) -> list[tuple[str, set[str]]]:
    """Drawn pages with the set of their article's blocks. Every block's text is its own. known: the share of named
    elements whose name says what they are; the others have made-up names."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(k: int) -> str:
        return " ".join("".join("bcdfglmnprstv"[int(rng.integers(13))] + "aeiou"[int(rng.integers(5))] for _ in range(int(rng.integers(1, 5)))) for _ in range(k))

    def made_up() -> str:
        return "z" + words(1) + "z"

    def prose(lo: int, hi: int) -> str:
        return words(int(rng.integers(lo, hi))).capitalize() + pick(".", ".", ".", "!", "?", "")

    def attr(names: str) -> str:
        name = pick(*names.split()) if chance(known) else pick(f"{made_up()}-{int(rng.integers(99))}", f"{made_up()} {made_up()}")
        return pick("", "", "", ' data-hidden="false"') + f' {pick("class", "id")}="{name}"' + pick("", "", "", f' title="The hidden {made_up()}"')

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(k)) + "</ul>"

    def noise(kind: str) -> str:
        few = int(rng.integers(2, 7))
        return {
            "menu": lambda: pick(f"<nav>{links(few)}</nav>", f"<div{attr(NAMES['menu'])}>{links(few)}</div>", f'<div role="navigation"><p>{words(2)}</p>{links(few)}</div>'),
            "head": lambda: pick(f"<header><h1>{words(2)}</h1><p>{prose(3, 10)}</p></header>", f"<div{attr(NAMES['head'])}><div>{words(2)}</div>{links(few)}</div>"),
            "foot": lambda: pick(f"<footer>&copy; {words(2)} &middot; {prose(3, 14)}</footer>", f"<footer><p>{prose(4, 14)}</p>{links(few)}</footer>", f"<div{attr(NAMES['foot'])}><p>{prose(3, 12)}</p></div>"),
            "side": lambda: pick(f"<aside><h3>{words(2)}</h3><p>{prose(4, 30)}</p>{links(few)}</aside>", f"<div{attr(NAMES['side'])}><h3>{words(2)}</h3>{links(few)}<p>{prose(4, 25)}</p></div>"),
            "ad": lambda: pick(f"<div{attr(NAMES['ad'])}>{prose(3, 20)}</div>", f"<div{attr(NAMES['ad'])}><p>{prose(3, 20)}</p></div>", f"<section{attr(NAMES['ad'])}><h4>{words(3)}</h4><p>{prose(5, 25)}</p></section>"),
            "notice": lambda: pick(f"<div{attr(NAMES['notice'])}>{prose(5, 25)}</div>", f"<div{attr(NAMES['notice'])}><p>{prose(5, 25)}</p><p>{words(2)}</p></div>"),
            "talk": lambda: f"<{(t := pick('div', 'section'))}{attr(NAMES['talk'])}><h3>{words(2)}</h3>" + "".join(f"<{(u := pick('div', 'article', 'li'))} class=\"{pick('comment', 'reply', 'comment-body')}\"><p>{prose(3, 40)}</p></{u}>" for _ in range(few)) + f"</{t}>",
            "share": lambda: f"<div{attr(NAMES['share'])}>{links(few)}</div>",
            "unseen": lambda: f"<{pick('div', 'p', 'section')}{pick(' hidden', ' aria-hidden=true', ' style=\'display:none\'')}>{prose(2, 25)}</div>" if chance(0.7) else f"<noscript>{prose(4, 14)}</noscript>",
            "form": lambda: f"<form><p>{prose(3, 12)}</p><label>{words(2)}</label><input name=q><button>{words(1)}</button></form>",
        }[kind]()

    out = []
    for _ in range(n):
        article: set[str] = set()

        def own(tag: str, text: str, article: set[str] = article) -> str:
            article.add(text)
            return f"<{tag}>{text}</{tag}>"

        def body(own=own) -> str:
            longest = pick(6, 30, 90)
            made = [own(pick("h1", "h1", "h2"), words(int(rng.integers(2, 12))))] if chance(0.8) else []
            for _ in range(int(rng.integers(1, pick(4, 9, 25)))):
                kind = rng.random()
                if kind < 0.7:
                    made.append(own("p", prose(1, longest)))
                elif kind < 0.78:
                    made.append(own(pick("h2", "h3"), words(int(rng.integers(1, 7)))))
                elif kind < 0.84:
                    made.append("<ul>" + "".join(own("li", prose(2, 15)) for _ in range(3)) + "</ul>")
                elif kind < 0.88:
                    made.append(f"<blockquote>{own('p', prose(5, 40))}</blockquote>")
                elif kind < 0.91:
                    made.append("<table><tr>" + "".join(own("td", words(2)) for _ in range(3)) + "</tr></table>")
                elif kind < 0.93:
                    made.append(f"<div>{own('p', prose(5, 60))}</div>")
                elif kind < 0.95:
                    made.append(pick(f"<noscript>{own('p', prose(8, 40))}</noscript>", f"<figure><img src=x>{own('figcaption', prose(3, 15))}</figure>", f"<div{attr(NAMES['main'])}>{own('p', prose(5, 60))}</div>"))
                else:
                    made.append(noise(pick("ad", "share", "side", "notice")))
            return "".join(made)

        inner = body()
        box = pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{attr(NAMES['main'])}>{inner}</div>", f"<div{attr(NAMES['main'])}><div>{inner}</div></div>", f"<section{attr(NAMES['main'])}>{inner}</section>")
        before = [noise(k) for k in ("head", "menu", "notice", "ad", "form", "unseen") if chance(0.5)]
        after = [noise(k) for k in ("share", "side", "ad", "talk", "form", "foot") if chance(0.5)]
        rng.shuffle(before)
        out.append(("<html><body>" + "".join(before) + box + "".join(after) + "</body></html>", article))
    return out


def fit(pages: list[tuple[str, set[str]]], rounds: int = 250, rate: float = 0.15, ridge: float = 1e-5) -> Weights:
    """Weights of the greatest likelihood of the labelled pages. An element is content if most of its text is."""
    trees = [parse(p) for p, _ in pages]
    names: dict[str, int] = {}
    rows, cols, parents, depths, labels, leaves = [], [], [], [], [], []
    base = 0
    for tree, (_, article) in zip(trees, pages, strict=True):
        n = len(tree.parent)
        inside, total = np.zeros(n), np.zeros(n)
        for i in range(n - 1, -1, -1):
            if tree.text[i] is not None:
                total[i], inside[i] = len(tree.text[i]), len(tree.text[i]) * (tree.text[i] in article)
            if tree.parent[i] >= 0:
                total[tree.parent[i]] += total[i]
                inside[tree.parent[i]] += inside[i]
        for i in range(n):
            for f in tree.features[i]:
                rows.append(base + i)
                cols.append(names.setdefault(f, len(names)))
        labels.append((inside * 2 > total).astype(float))
        parents.append(np.where(np.array(tree.parent) >= 0, np.array(tree.parent) + base, -1))
        depths.append(np.array(tree.depth))
        leaves.append(np.array([x is not None for x in tree.text]))
        base += n
    y, parent, depth, leaf = np.concatenate(labels), np.concatenate(parents), np.concatenate(depths), np.concatenate(leaves).astype(np.int64)
    rows, cols = np.array(rows), np.array(cols)
    child = np.flatnonzero(parent >= 0)
    up = parent[child]
    theta = np.zeros(len(names) + 8)  # the weights of the features, then the pair potentials
    first, second = np.zeros(len(theta)), np.zeros(len(theta))
    kind, above, own = leaf[child], y[up].astype(np.int64), y[child].astype(np.int64)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind, above, own), 1)
    for k in range(1, rounds + 1):
        w, pair = theta[: len(names)], theta[len(names) :].reshape(2, 2, 2)
        content, joint = sum_product(parent, depth, leaf, np.bincount(rows, weights=w[cols], minlength=len(y)), pair)
        miss = y - content
        change = seen - np.stack([joint[child[kind == c]].sum(axis=0) for c in (0, 1)])
        slope = np.concatenate((np.bincount(cols, weights=miss[rows], minlength=len(names)), change.ravel())) / len(y) - ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    w, pair = theta[: len(names)], theta[len(names) :].reshape(2, 2, 2)
    return Weights({f: float(w[i]) for f, i in names.items()}, pair)


def trained() -> Weights:
    """Weights from drawn pages of which three tenths of the named elements have made-up names, so that structure counts too."""
    return fit(labelled_pages(known=0.7))


def extract(df: DataFrame, weights: Weights, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each page; a column of that name is replaced."""
    df = df.drop(out)
    at = df.columns.index(html)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, at):
            texts: list[str] = []
            for a in range(0, batch.num_rows, 256):
                trees = [parse(p or "") for p in batch.column(at).slice(a, 256).to_pylist()]
                texts += ["\n\n".join(kept) for kept in keep(trees, shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return in_arrow(df, run, typed(df, (out, T.StringType())))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, trained(), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
