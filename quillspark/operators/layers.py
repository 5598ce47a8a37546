"""Verse layers of a work set against each other, stanza by stanza, with array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

GROUP, GROUP_FROM = 4, 8


def _lines(block: Column) -> Column:
    return F.filter(X.lines(block), lambda x: X.strip(x) != "")


def _shape(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.size(_lines(b)))


def display_stanzas(c: Column) -> Column:
    """Stanzas, those of eight lines or more cut into groups of four."""

    def one(block: Column) -> Column:
        own = _lines(block)
        starts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(GROUP))
        return F.when(F.size(own) < GROUP_FROM, F.array(block)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(own, s, GROUP), "\n")))

    return F.flatten(F.transform(X.stanzas(c), one))


def _cut_like(blocks: Column, layer: Column, per_line: int) -> Column:
    """A layer's lines cut to the blocks' line counts, null if the totals differ."""
    own = _lines(layer)
    shape = F.transform(_shape(blocks), lambda n: n * per_line)
    total = F.aggregate(shape, F.lit(0), lambda s, n: s + n)
    starts = F.transform(shape, lambda _, i: F.aggregate(F.slice(shape, F.lit(1), i), F.lit(0), lambda s, n: s + n))
    made = F.zip_with(starts, shape, lambda s, n: F.array_join(F.slice(own, s + 1, n), "\n"))
    return F.when((F.size(own) > 0) & (total == F.size(own)), made)


def _two_halves(blocks: Column) -> Column:
    """Whether two lines in three or more have the wide gap between the halves of a verse."""
    own = F.flatten(F.transform(blocks, _lines))
    gapped = F.filter(own, lambda x: x.rlike("\\S[ \\t\u00a0]{2,}\\S"))
    return (F.size(own) > 0) & (F.size(gapped) * 3 >= F.size(own) * 2)


def by_shape(blocks: Column, layer: Column) -> Column:
    """The layer's blocks if lines correspond: equal shapes, equal totals, or two lines for each half-line pair; else null."""
    own = X.stanzas(layer)
    return F.coalesce(F.when((F.size(own) > 0) & (_shape(own) == _shape(blocks)), own), _cut_like(blocks, layer, 1), F.when(_two_halves(blocks), _cut_like(blocks, layer, 2)))


def by_count(blocks: Column, layer: Column) -> Column:
    own = X.stanzas(layer)
    return F.when((F.size(own) > 0) & (F.size(own) == F.size(blocks)), own)


def layout(lyrics: Column, latin: Column, translation: Column) -> Column:
    """(rows, loose): rows of (original, latin, translation), and the layers shown whole.

    Display stanzas come first, then the source's own; a pass holds if it places any layer, or there is none. Each
    layer is placed or left out by itself. If neither pass holds, all layers are one row.
    """
    layers = {"latin": X.blank(latin), "translation": X.blank(translation)}
    present = {k: X.strip(c) != "" for k, c in layers.items()}
    none = ~present["latin"] & ~present["translation"]

    def attempt(blocks: Column, match) -> tuple[Column, Column]:
        found = {k: F.when(present[k], match(blocks, c)) for k, c in layers.items()}
        holds = (F.size(blocks) > 0) & (none | found["latin"].isNotNull() | found["translation"].isNotNull())
        rows = F.transform(blocks, lambda b, i: F.struct(b.alias("original"), *[F.coalesce(F.try_element_at(found[k], i + 1), F.lit("")).alias(k) for k in layers]))
        loose = F.array_compact(F.array(*[F.when(present[k] & found[k].isNull(), k) for k in layers]))
        return holds, F.struct(rows.alias("rows"), loose.alias("loose"))

    fine, fine_made = attempt(display_stanzas(lyrics), by_shape)
    own, own_made = attempt(X.stanzas(lyrics), by_count)
    whole = F.struct(
        F.array(F.struct(X.strip(X.blank(lyrics)).alias("original"), *[X.strip(c).alias(k) for k, c in layers.items()])).alias("rows"),
        F.array_compact(F.array(*[F.when(present[k], k) for k in layers])).alias("loose"),
    )
    return F.when(fine, fine_made).when(own, own_made).otherwise(whole)


def available_layers(lyrics: Column, transliteration: Column, translation: Column) -> Column:
    return F.array_compact(F.array(*[F.when(X.strip(X.blank(c)) != "", n) for n, c in (("lyrics", lyrics), ("transliteration", transliteration), ("translation", translation))]))
