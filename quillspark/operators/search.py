"""Visibility, search, filters and facets of the library."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .checkpoints import cut


def visible(works: DataFrame, staff: bool = False) -> DataFrame:
    """Readers see approved works, staff all."""
    return works if staff else works.where(F.col("review_state") == "approved")


def matches_all(document: Column, folded_query: str) -> Column:
    """Every term of a folded query is in the folded document, literally."""
    terms = folded_query.split()
    return reduce(and_, [F.contains(document, F.lit(t)) for t in terms], F.lit(True))


def same_text(a: Column, b: Column | str) -> Column:
    """Equal whatever the case."""
    return F.upper(a) == F.upper(F.lit(b) if isinstance(b, str) else b)


def any_column_has(columns: Iterable[Column], term: str) -> Column:
    return reduce(or_, [F.contains(F.upper(X.blank(c)), F.lit(term.upper())) for c in columns])


def keyword_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows where every term is in some column, whatever the case."""
    return df.where(reduce(and_, [any_column_has([F.col(c) for c in columns], t) for t in query.split()], F.lit(True)))


def with_all_tags(works: DataFrame, bridge: DataFrame, tags: list[str], work: str = "id", bridge_work: str = "work_id", tag: str = "tag") -> DataFrame:
    """Works that have every one of the tags: one pass over the bridge, then a semi-join on the works that have them all."""
    names = sorted({t.upper() for t in tags})
    if not names:
        return works
    have = bridge.where(F.upper(tag).isin(names)).groupBy(bridge_work).agg(F.countDistinct(F.upper(tag)).alias("n")).where(F.col("n") == len(names))
    return works.join(have, works[work] == have[bridge_work], "left_semi")


def read_values(values: Iterable[str]) -> list[str]:
    """Values without blanks and repeats; of spellings that differ in case the first stays."""
    out: dict[str, str] = {}
    for v in values:
        if v.strip():
            out.setdefault(v.strip().lower(), v.strip())
    return list(out.values())


def facet(scope: DataFrame, column: str, work: str = "id", limit: int | None = None) -> DataFrame:
    """Distinct works of each value, most first; blank values are none."""
    found = scope.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.countDistinct(work).alias("n"))
    found = found.orderBy(F.desc("n"), F.asc(column))
    return found.limit(limit) if limit else found


def scoped_facets(works: DataFrame, chosen: Mapping[str, Column], facets: Mapping[str, str]) -> DataFrame:
    """(facet, value, n) of several facets in one pass, each counted with its own filter lifted.

    chosen: the predicate of each filter; facets: the column of each facet. A facet's scope is the conjunction of all
    predicates but the one that bears its name. Works are rows, one each, so no distinct count is needed.
    """
    held = {k: F.coalesce(p, F.lit(False)) for k, p in chosen.items()}
    scope = lambda name: reduce(and_, [p for k, p in held.items() if k != name], F.lit(True))
    each = F.array(*[F.struct(F.lit(name).alias("facet"), F.when(scope(name), F.col(column)).alias("value")) for name, column in facets.items()])
    rows = works.select(F.explode(each).alias("f")).select("f.*")
    return rows.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("facet", "value").agg(F.count("*").alias("n"))


def tagged_facets(works: DataFrame, bridge: DataFrame, tags: list[str], chosen: Mapping[str, Column], facets: Mapping[str, str], work: str = "id", bridge_work: str = "work_id", tag: str = "tag") -> DataFrame:
    """scoped_facets with a tag filter, and the facet `tag`: it counts works under all filters, the tags among them, since tags are joined by and."""
    held = with_all_tags(works, bridge, tags, work, bridge_work, tag)
    scope = held.where(reduce(and_, [F.coalesce(p, F.lit(False)) for p in chosen.values()], F.lit(True))).select(work)
    own = bridge.select(F.col(bridge_work).alias("_w"), F.col(tag).alias("value")).where("value <> ''")
    tagged = own.join(scope, own["_w"] == scope[work], "left_semi").groupBy("value").agg(F.countDistinct("_w").alias("n"))
    return scoped_facets(held, chosen, facets).unionByName(tagged.select(F.lit("tag").alias("facet"), "value", "n"))


def grouped_by_axis(tag_counts: DataFrame, active: Iterable[str] = ()) -> DataFrame:
    """(axis, total, items) in the fixed order of axes; in each, active tags first, then by count and label."""
    axis, on = X.tag_axis(F.col("tag")), F.lower("tag").isin([a.lower() for a in active]) if active else F.lit(False)
    rows = tag_counts.withColumns({"axis": axis, "off": F.when(on, 0).otherwise(1), "minus": -F.col("n"), "label": X.tag_label(F.col("tag"))})
    items = F.transform(F.array_sort(F.collect_list(F.struct("off", "minus", "label", "tag"))), lambda x: F.struct(x["tag"].alias("tag"), x["label"].alias("label"), (-x["minus"]).alias("n")))
    order = F.array_position(F.array(*[F.lit(a) for a in X.TAG_AXES]), F.col("axis"))
    return rows.groupBy("axis").agg(F.sum("n").alias("total"), items.alias("items")).orderBy(order)


MISSING = ("author", "dedication", "language", "lyrics", "transliteration", "translation", "tags")


def still_missing(works: DataFrame, bridge: DataFrame, gap: str) -> DataFrame:
    """Works with a gap: a null key, blank text, or no tag. An unknown gap narrows nothing."""
    if gap in ("author", "dedication"):
        return works.where(F.col(f"{gap}_id").isNull())
    if gap in ("language", "lyrics", "transliteration", "translation"):
        return works.where(F.col(gap) == "")
    if gap == "tags":
        return works.join(bridge, works["id"] == bridge["work_id"], "left_anti")
    return works


def page(df: DataFrame, order: list[Column], number: int, size: int = 24) -> DataFrame:
    """A page of the ordered rows; below the first it is the first, past the last the last."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def suggest(works: DataFrame, folded_query: str, limit: int = 8) -> DataFrame:
    """Up to `limit` titles with the number of all that match; nothing for fewer than two characters."""
    if len(folded_query.strip()) < 2:
        return works.limit(0).select("id", "title").withColumn("total", F.lit(0).cast("long"))
    found = cut(works.where(matches_all(F.col("search_text"), folded_query)).select("id", "title"))  # the texts are read once
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("title", "id").limit(limit).select("id", "title").crossJoin(F.broadcast(total))  # one row
