"""Sinks: works with their derived columns, tombstones, JSON, sitemaps, printable documents, media names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequential as Q
from ..functions import text as X
from ..operators import relations as R


def with_derived(works: DataFrame) -> DataFrame:
    """Works held to their columns' lengths, with search_text and signature, which are made once, on write, from composed characters."""
    cut = {"title": F.substring(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")), 1, 200), "native_title": F.substring(X.blank(F.col("native_title")), 1, 200), "language": F.substring(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("Unknown")), 1, 50)}
    own = works.withColumns(cut)
    composed = [Q.nfkc(c) for c in ("title", "native_title", "author", "dedication", "lyrics", "transliteration", "translation")]
    return own.withColumns({"search_text": X.search_document(*composed), "signature": X.signature(composed[4], composed[5])})


def new_works(crawled: DataFrame, known: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Crawled works with a safe address that is neither known nor deleted, once each."""
    safe = crawled.withColumn("source_url", X.safe_source_url(F.col("source_url"))).where("source_url <> ''")
    gone = known.select("source_url").union(tombstones.select("source_url")).distinct()
    return safe.dropDuplicates(["source_url"]).join(gone, "source_url", "left_anti")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only the rows whose columns differ: what a batched update writes."""
    before = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_was"))
    return new.join(before, new[key] == before["_k"]).where(~F.struct(*columns).eqNullSafe(F.col("_was"))).drop("_k", "_was")


def tombstones_of(deleted: DataFrame) -> DataFrame:
    return deleted.where(X.blank(F.col("source_url")) != "").select("source_url").distinct()


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def sitemap_lines(entries: DataFrame, per_page: int = 2_000) -> DataFrame:
    """(section, value): an XML line for each (id, loc, lastmod, priority), numbered in the order of ids."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<url><loc>"), esc(F.col("loc")), F.lit("</loc><lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod><priority>"), F.col("priority"), F.lit("</priority></url>"))
    return R.numbered(entries, ["id"], "_n").select(F.floor(F.col("_n") / per_page).alias("section"), line.alias("value"))


def printable(title: Column, poet: Column, layers: dict[str, Column]) -> Column:
    """HTML of a work for printing: a heading and its chosen layers, each stanza a paragraph with its direction."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda name, c: F.when(
        X.strip(X.blank(c)) != "",
        F.concat(F.lit(f'<section class="{name}" dir="'), X.direction(c), F.lit('">'), F.array_join(F.transform(X.stanzas(c), lambda s: F.concat(F.lit("<p>"), F.replace(esc(s), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), ""), F.lit("</section>")),
    ).otherwise("")
    head = F.concat(F.lit("<h1>"), esc(title), F.lit("</h1>"), F.when(X.blank(poet) != "", F.concat(F.lit("<h2>"), esc(poet), F.lit("</h2>"))).otherwise(""))
    return F.concat(head, *[part(n, c) for n, c in layers.items()])


def file_name(title: Column, layers: list[str]) -> Column:
    return F.concat(F.coalesce(F.nullif(X.slugify(title), F.lit("")), F.lit("work")), F.lit("-" + "-".join(layers) + ".pdf"))


def media_name(url: Column, extension: str = "jpg") -> Column:
    """stem-hash.extension of a stored scan."""
    stem = F.substring(X.slugify(F.regexp_replace(F.substring_index(url, "/", -1), r"(?i)\.(jpe?g|png|gif|webp)$", "")), 1, 60)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("scan")), F.lit("-"), F.substring(F.sha1(url), 1, 10), F.lit(f".{extension}"))
