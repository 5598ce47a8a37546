"""Secret scan with DataFrame functions only: patterns, and sliding-window entropy over candidate strings.

Base spans are the leftmost non-overlapping matches of three patterns (assign, access, hex). The method adds spans:
a candidate is a maximal run of 20 or more of `[A-Za-z0-9+/_-]` outside the base spans. Its class follows from the
characters it holds: `entropy_hex` (hexadecimal digits only), `entropy_base64` (both cases and digits), `entropy_lower`
and `entropy_upper` (one case and digits), `entropy_letters` (both cases, no digit); letters of one case only, or digits
only, are words and numbers. A window slides over the candidate; a fold keeps how often each character is in the window
and the sum of c * log2(c), and changes both by the character that comes in and the one that goes out. The span is what
the windows of at least the class's entropy cover. The allow-list (UUIDs, examples, words and numbers joined by marks,
and in the last three classes runs that hardly change between digits and letters, or between cases) suppresses added
spans; base spans always stay.

Positions are code points, ends exclusive. They come from the lengths of matches and of the text between them, added
up in blocks. No pattern repeats a group and no character is looked up by walking the text, so neither a very long
candidate nor very many matches cost much more than the text's length.

Defined results: a null text counts as empty and has no span. Keys may be null or repeated; every row comes back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: In the order of the spans string for equal starts.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_letters")
#: Window and least entropy in bits of each class.
WINDOW = {"entropy_hex": (24, 3.05), "entropy_base64": (20, 3.85), "entropy_lower": (20, 3.85), "entropy_upper": (20, 3.85), "entropy_letters": (20, 3.95)}
#: Candidates that are no secrets: UUIDs and documented examples, and
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"EXAMPLE")
#: those without any of these: words (small, capital, or with a first capital) and numbers joined by marks have none.
BROKEN = r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"
#: In classes that words with numbers or capitals share, a secret changes so often at least from the one to the other.
CHANGES = {"entropy_lower": (r"[0-9]+[a-z]", 2), "entropy_upper": (r"[0-9]+[A-Z]", 2), "entropy_letters": (r"[a-z]+[A-Z]", 4)}
MASK = "[SECRET]"
_ALPHABET = "".join(sorted("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
_BLOCK = 64
#: c * log2(c) as whole numbers, so that sums over a long candidate stay exact.
_SCALE = 1 << 24
#: Counts are kept in longs, eight characters of five bits each.
_BITS, _EACH = 5, 8


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, combine) -> Column:
    """For each number, what combine makes of 0 and those before it; in blocks, so that the work is not the square of the size."""
    upto = lambda xs, n, s: F.aggregate(F.slice(xs, F.lit(1), n), s, combine)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / _BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK))
    own = lambda blocks, sums: F.transform(blocks, lambda x, b: _let(upto(sums, b, F.lit(0)), lambda s: F.transform(x, lambda _, i: upto(x, i, s))))
    return _let(values, lambda xs: _let(cut(xs), lambda blocks: _let(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), combine)), lambda sums: F.flatten(own(blocks, sums)))))


def _matches(text: str, pattern: str) -> tuple[Column, Column]:
    """(matches, (characters, bytes) of the text before each and after the last); both empty for most rows, at the cost of one search."""
    t, p = F.col(text), F.lit(pattern)
    hit = t.rlike(pattern)
    gaps = F.transform(F.split(t, pattern, -1), lambda g: F.struct(F.length(g).alias("c"), F.octet_length(g).alias("b")))
    return F.when(hit, F.regexp_extract_all(t, p, F.lit(0))).otherwise(F.array().cast("array<string>")), F.when(hit, gaps).otherwise(F.array().cast("array<struct<c:int,b:int>>"))


def _spans(found: Column, gaps: Column) -> Column:
    """Array of (start, end, at, text) of the matches, which are ASCII; `at` is the start in bytes."""
    add = lambda s, x: s + x
    own = F.slice(gaps, 1, F.size(found))
    sizes = F.transform(found, F.length)
    starts = lambda unit: F.zip_with(_before(F.zip_with(own, sizes, lambda g, n: g[unit] + n), add), own, lambda b, g: b + g[unit])
    places = F.zip_with(F.zip_with(starts("c"), starts("b"), lambda c, b: F.struct(c.alias("c"), b.alias("b"))), found, lambda x, m: F.struct(x["c"].alias("start"), (x["c"] + F.length(m)).alias("end"), x["b"].alias("at"), m.alias("text")))
    return F.when(F.size(found) > 0, places).otherwise(F.array().cast("array<struct<start:int,end:int,at:int,text:string>>"))


def _named(start: Column, kind: Column, end: Column, at: Column) -> Column:
    return F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), at.alias("at"))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: _named(s["start"], F.lit(KINDS.index(kind)), s["end"], s["at"]))


def covered(text: Column, spans: Column, put) -> Column:
    """The text with what each group of overlapping sorted spans covers replaced by put(number of characters)."""
    raw = text.cast("binary")
    last = lambda xs: F.transform(xs, lambda s: s["at"] + s["end"] - s["start"])
    heads = lambda xs, before: F.filter(F.zip_with(xs, before, lambda s, b: F.struct(b.alias("upto"), s["at"].alias("at"))), lambda h: h["at"] >= h["upto"])
    piece = lambda t, h, end: F.concat(F.substring(t, h["upto"] + 1, h["at"] - h["upto"]).cast("string"), put(end - h["at"]))

    def made(t: Column, xs: Column, ends: Column) -> Column:
        return _let(F.array_max(ends), lambda end: _let(heads(xs, _before(ends, lambda s, x: F.greatest(s, x))), lambda hs: F.concat(
            F.array_join(F.transform(hs, lambda h, i: piece(t, h, F.coalesce(F.try_element_at(hs, i + 2)["upto"], end))), ""), F.substring(t, end + 1, F.octet_length(t)).cast("string"),
        )))

    return F.when(F.size(spans) > 0, _let(raw, lambda t: _let(spans, lambda xs: _let(last(xs), lambda ends: made(t, xs, ends))))).otherwise(text)


def hot_range(candidate: Column, window: Column, most: Column) -> Column:
    """(start, end) of what the windows whose sum of c * log2(c) is `most` at most cover, within the candidate; start -1 if none does.

    The state of the fold holds a count for each character and the sum, both kept up to date by the one character that
    enters and the one that leaves.
    """
    widest = max(w for w, _ in WINDOW.values())
    worth = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(widest + 2)]
    gain = F.array(*[F.lit(worth[c + 1] - worth[c]).cast("long") for c in range(widest + 1)])
    one = F.array(*[F.lit(1 << (_BITS * j)).cast("long") for j in range(_EACH)])
    longs = -(-len(_ALPHABET) // _EACH)

    def shift(code: Column) -> Column:
        return code.bitwiseAND(F.lit(_EACH - 1)) * _BITS

    def held(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, F.shiftright(code, 3) + 1), shift(code)).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

    def unit(code: Column, k: Column) -> Column:
        return F.when(F.shiftright(code, 3) == k, F.element_at(one, code.bitwiseAND(F.lit(_EACH - 1)) + 1)).otherwise(F.lit(0).cast("long"))

    def change(s: Column, at: Column, into: Column, out: Column) -> Column:
        rest = F.when(out >= 0, F.element_at(gain, held(s["counts"], out))).otherwise(F.lit(0).cast("long"))
        total = F.when(into == out, s["sum"]).otherwise(s["sum"] + F.element_at(gain, held(s["counts"], into) + 1) - rest)
        counts = F.when(into == out, s["counts"]).otherwise(F.transform(s["counts"], lambda n, k: n + unit(into, k) - F.when(out >= 0, unit(out, k)).otherwise(F.lit(0).cast("long"))))
        hot = lambda sums: (at >= window) & (sums <= most)
        return _let(total, lambda t: F.struct(
            counts.alias("counts"), t.alias("sum"), F.when(hot(t) & (s["start"] < 0), at - window).otherwise(s["start"]).alias("start"), F.when(hot(t), at).otherwise(s["end"]).alias("end"),
        ))

    def slide(raw: Column) -> Column:
        code = lambda i: F.instr(F.lit(_ALPHABET), F.substring(raw, i, F.lit(1)).cast("string")) - 1
        state = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("start"), F.lit(0).alias("end"))
        enter = lambda s, i: _let(code(i), lambda into: _let(F.when(i > window, code(i - window)).otherwise(F.lit(-1)), lambda out: change(s, i, into, out)))
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(raw)), state, enter, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return _let(candidate.cast("binary"), slide)


def classified(c: Column) -> Column:
    """The class of a candidate, as a place in KINDS; null where it is none or on the allow-list."""
    lower, upper, digit = c.rlike("[a-z]"), c.rlike("[A-Z]"), c.rlike("[0-9]")
    often = {k: F.regexp_count(c, F.lit(p)) >= n for k, (p, n) in CHANGES.items()}
    kind = (
        F.when(c.rlike("^[0-9a-fA-F]+$"), "entropy_hex").when(lower & upper & digit, "entropy_base64").when(lower & digit & often["entropy_lower"], "entropy_lower")
        .when(upper & digit & often["entropy_upper"], "entropy_upper").when(lower & upper & ~digit & often["entropy_letters"], "entropy_letters")
    )
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1
    return F.when(c.rlike(BROKEN) & ~F.greatest(*[c.rlike(p) for p in ALLOWED]), place.cast("int"))


def _entropy(candidates: Column) -> Column:
    """The added spans of the candidates."""
    windows = F.array(*[F.lit(WINDOW.get(k, (0, 0))[0]) for k in KINDS])
    most = F.array(*[F.lit(int((math.log2(WINDOW[k][0]) - WINDOW[k][1]) * WINDOW[k][0] * _SCALE) if k in WINDOW else 0).cast("long") for k in KINDS])
    kinds = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["at"].alias("at"), c["text"].alias("text"), classified(c["text"]).alias("kind")))
    ranged = F.transform(F.filter(kinds, lambda c: c["kind"].isNotNull()), lambda c: F.struct(c.alias("c"), hot_range(c["text"], F.element_at(windows, c["kind"] + 1), F.element_at(most, c["kind"] + 1)).alias("hot")))
    return F.transform(F.filter(ranged, lambda r: r["hot"]["start"] >= 0), lambda r: _named(r["c"]["start"] + r["hot"]["start"], r["c"]["kind"], r["c"]["start"] + r["hot"]["end"], r["c"]["at"] + r["hot"]["start"]))


def scan(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "all_spans") -> DataFrame:
    """df with two sorted arrays of (start, kind, end, at), kind a place in KINDS, at the start in bytes: the base spans, and all spans."""
    df = df.drop(base, spans)
    t, blank = fresh_name(df, "scanned"), fresh_name(df, "blanked")
    kept = df.columns
    rows = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))

    def search(rows: DataFrame, kind: str, pattern: str, where: str) -> tuple[DataFrame, Column]:
        m, g, own = (fresh_name(df, f"{x}_{kind}") for x in ("found", "gaps", "spans"))
        found, gaps = _matches(where, pattern)
        return rows.withColumns({m: found, g: gaps}).withColumn(own, _spans(F.col(m), F.col(g))), F.col(own)

    rows, assign = search(rows, "assign", ASSIGN, t)
    rows, access = search(rows, "access", ACCESS, t)
    rows, hex_ = search(rows, "hex", HEX, t)
    # The value of an assignment is what follows its quote, sign and spaces: the run of value characters at its end.
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    found = F.concat(_kind(F.filter(assign, lambda s: value(s["text"]) >= 8), "assign"), _kind(F.filter(access, lambda s: F.length(s["text"]) >= 16), "access"), _kind(hex_, "hex"))
    rows = rows.withColumn(base, F.array_sort(found))
    # Blanks instead of the base spans: candidates are runs of the rest, at the same places.
    rows = rows.withColumn(blank, covered(F.col(t), F.col(base), lambda n: F.repeat(F.lit(" "), n)))
    rows, candidates = search(rows, "candidate", CANDIDATE, blank)
    every = F.when(F.size(candidates) > 0, F.array_sort(F.concat(F.col(base), _entropy(candidates)))).otherwise(F.col(base))
    return rows.withColumn(spans, every).select(*kept, base, spans)


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with each span (overlapping ones together) replaced by a mask, and the size column, if any, counted anew. Rows stay;
    a text without a span, a null one too, stays as it is."""
    base, spans = fresh_name(docs, "base_spans"), fresh_name(docs, "all_spans")
    found = scan(docs, text, base, spans)
    masked = found.withColumn(text, covered(F.col(text), F.col(spans), lambda _: F.lit(MASK)))
    if size in docs.columns:
        masked = masked.withColumn(size, F.when(F.size(spans) > 0, F.length(text).cast(docs.schema[size].dataType)).otherwise(F.col(size)))
    return masked.select(*docs.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
pats AS (
  SELECT * FROM (VALUES
    (0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{32,}')) AS p(kind, pat)
),
hits AS (
  SELECT rid, kind, CASE kind WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]{32,}') END AS ms,
    CASE kind WHEN 0 THEN regexp_split_to_array(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_split_to_array(t, '[0-9a-f]{32,}') END AS gs
  FROM docs CROSS JOIN (SELECT DISTINCT kind FROM pats)
),
each AS (SELECT rid, kind, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM hits WHERE len(ms) > 0),
placed AS (
  SELECT rid, kind, ms[i] AS m, sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY rid, kind ORDER BY i) - length(ms[i]) AS s FROM each
),
base AS (
  SELECT rid, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM placed
  WHERE kind = 2 OR kind = 1 AND length(m) >= 16
    OR kind = 0 AND length(regexp_extract(m, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 8
),
marked AS (SELECT rid, s, e, coalesce(max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, max(e) OVER (PARTITION BY rid) AS last FROM base),
heads AS (SELECT rid, s, upto, last, coalesce(lead(upto) OVER (PARTITION BY rid ORDER BY s), last) AS e FROM marked WHERE s >= upto),
blanked AS (SELECT rid, string_agg(substr(t, upto + 1, s - upto) || repeat(' ', e - s), '' ORDER BY s) || substr(any_value(t), max(last) + 1) AS t FROM heads JOIN docs USING (rid) GROUP BY rid),
runs AS (
  SELECT rid, regexp_extract_all(b, '[A-Za-z0-9+/_-]{20,}') AS ms, regexp_split_to_array(b, '[A-Za-z0-9+/_-]{20,}') AS gs
  FROM (SELECT d.rid, coalesce(b.t, d.t) AS b FROM docs d LEFT JOIN blanked b ON b.rid = d.rid)
),
every_run AS (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM runs WHERE len(ms) > 0),
placed_run AS (SELECT rid, ms[i] AS m, sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY rid ORDER BY i) - length(ms[i]) AS s FROM every_run),
cand AS (
  SELECT rid, s, m, CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN 3
    WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') THEN 4
    WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]') AND len(regexp_extract_all(m, '[0-9]+[a-z]')) >= 2 THEN 5
    WHEN regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') AND len(regexp_extract_all(m, '[0-9]+[A-Z]')) >= 2 THEN 6
    WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND NOT regexp_matches(m, '[0-9]') AND len(regexp_extract_all(m, '[a-z]+[A-Z]')) >= 4 THEN 7 END AS kind
  FROM placed_run
  WHERE NOT regexp_matches(m, 'EXAMPLE') AND NOT regexp_full_match(m, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')
    AND regexp_matches(m, '[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]')
),
windows AS (
  SELECT rid, s, kind, CASE kind WHEN 3 THEN 24 ELSE 20 END AS w, m, unnest(range(0, CAST(length(m) - CASE kind WHEN 3 THEN 24 ELSE 20 END + 1 AS BIGINT))) AS off FROM cand WHERE kind IS NOT NULL
),
hot AS (
  SELECT rid, s, kind, s + min(off) AS hs, s + max(off + w) AS he FROM windows
  WHERE list_aggregate(string_split(substr(m, CAST(off + 1 AS BIGINT), CAST(w AS BIGINT)), ''), 'entropy') >= CASE kind WHEN 3 THEN 3.05 WHEN 7 THEN 3.95 ELSE 3.85 END GROUP BY rid, s, kind
),
every AS (
  SELECT rid, kind, s, e FROM base UNION ALL SELECT rid, kind, CAST(hs AS BIGINT), CAST(he AS BIGINT) FROM hot
),
named AS (
  SELECT rid, kind, s, e, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' WHEN 3 THEN 'entropy_hex'
    WHEN 4 THEN 'entropy_base64' WHEN 5 THEN 'entropy_lower' WHEN 6 THEN 'entropy_upper' ELSE 'entropy_letters' END || ':' || s || ':' || e AS span FROM every
),
summed AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
    coalesce(string_agg(span, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3), '') AS b, string_agg(span, ',' ORDER BY s, kind, e) AS a
  FROM named GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM docs LEFT JOIN summed USING (rid)
"""
