"""Sources of crawled material. Fetching is not part of them: each reads pages that something else has stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequential as Q
from ..functions import text as X

#: Caps of discovery; fixed values.
MOST_URLS, MOST_SITEMAPS = 2_000, 20


_POST = "link string, title struct<rendered:string>, content struct<rendered:string>, tags array<int>"


def paged_posts(pages: DataFrame, number: str = "number", part: str = "part", body: str = "body") -> DataFrame:
    """(link, title, html, label_ids) of stored answers of a paged REST listing.

    pages has a row for each stored page: its number, part (0: the whole page; from 1 on: the page stored again in
    smaller parts after a failure) and body. A whole page that can be read counts; else its parts do. The listing ends
    before the first page that is missing or answers with an error object instead of a list.
    """
    parsed = pages.select(F.col(number).alias("n"), F.col(part).alias("p"), F.from_json(body, f"array<struct<{_POST}>>").alias("posts"), F.try_parse_json(body).alias("v"))
    ok = F.col("posts").isNotNull() & (F.substring(F.trim(F.to_json("v")), 1, 1) == "[")
    rows = parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))
    whole = rows.groupBy("n").agg(F.max((F.col("p") == 0) & F.col("ok")).alias("whole"), F.max("ok").alias("any"))
    # Page numbers are few; the first gap is a minimum over them.
    last = whole.where("any").select(F.col("n").alias("m")).distinct()
    gap = last.select((F.col("m") + 1).alias("m")).join(last, "m", "left_anti").agg(F.min("m").alias("end"))
    used = rows.join(whole, "n").where(F.col("ok") & ((F.col("p") == 0) == F.col("whole"))).crossJoin(F.broadcast(gap)).where(F.col("n") < F.col("end"))  # one row
    return used.select(F.explode("posts").alias("x")).select("x.link", F.col("x.title.rendered").alias("title"), F.col("x.content.rendered").alias("html"), F.col("x.tags").alias("label_ids"))


def uniform_posts(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """(link, title, html, labels) with the names of label ids; terms (id, name, prefix) are a site's taxonomy."""
    names = terms.select(F.col("id").alias("_t"), F.concat(F.coalesce("prefix", F.lit("")), "name").alias("_name"))
    each = posts.select("link", "title", "html", F.posexplode_outer("label_ids").alias("_at", "_id"))
    labelled = each.join(names, each["_id"] == names["_t"], "left").groupBy("link", "title", "html").agg(F.sort_array(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_at", "_name")))).alias("_l"))
    return labelled.select("link", X.clean_html_title(F.col("title")).alias("title"), "html", F.transform("_l", lambda x: x["_name"]).alias("labels"))


def feed_posts(pages: DataFrame, body: str = "body") -> DataFrame:
    """(link, title, html, labels) of stored feed pages in JSON."""
    entry = "struct<title:struct<`$t`:string>,content:struct<`$t`:string>,link:array<struct<rel:string,href:string>>,category:array<struct<term:string>>>"
    rows = pages.select(F.explode(F.from_json(body, f"feed struct<entry:array<{entry}>>")["feed"]["entry"]).alias("e"))
    link = F.try_element_at(F.filter("e.link", lambda x: x["rel"] == "alternate"), F.lit(1))["href"]
    return rows.select(link.alias("link"), F.col("e.title.$t").alias("title"), F.col("e.content.$t").alias("html"), F.transform(F.coalesce("e.category", F.array()), lambda c: c["term"]).alias("labels"))


def bundle_records(bundles: DataFrame, body: str = "body") -> DataFrame:
    """(url, title) of the records in script bundles; of a URL's records the first counts."""
    both = F.regexp_extract_all(body, F.lit(r'\{[^{}]*?url:"([^"]+)"[^{}]*?\}'), F.lit(0))
    each = bundles.select(F.posexplode(both).alias("at", "r"))
    return each.select(F.regexp_extract("r", r'url:"([^"]+)"', 1).alias("url"), F.regexp_extract("r", r'title:"([^"]*)"', 1).alias("title"), "at").groupBy("url").agg(F.min_by("title", "at").alias("title"))


def sitemap_urls(sitemaps: DataFrame, host: str, most_urls: int = MOST_URLS, most_maps: int = MOST_SITEMAPS) -> DataFrame:
    """URLs of a site's map (url, body): one level of index, at most 20 maps and 2,000 URLs of the same host (limits of the feature)."""
    locs = F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    is_index = F.contains("body", F.lit("<sitemapindex"))
    named = sitemaps.where(is_index).select(F.explode(locs).alias("url")).where(X.same_host(F.col("url"), F.lit(host))).distinct().orderBy("url").limit(most_maps)
    maps = sitemaps.where(~is_index)
    maps = maps if sitemaps.where(is_index).isEmpty() else maps.join(named, "url", "left_semi")
    return maps.select(F.explode(locs).alias("url")).where(X.same_host(F.col("url"), F.lit(host)) & ~F.col("url").rlike(r"\.xml$")).distinct().orderBy("url").limit(most_urls)


def archive_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(path, url) of index lines `url timestamp`: of a page's captures the canonical address, else the first line's."""
    rows = spark.read.text(path).select(F.split("value", " ").alias("p"), F.monotonically_increasing_id().alias("at")).where(F.size("p") >= 2)
    rows = rows.select(F.col("p")[0].alias("url"), F.col("p")[1].alias("stamp"), F.regexp_replace(F.lower(F.regexp_replace(F.col("p")[0], r"[?#].*$", "")), r"^https?://(www\.)?|/+$", "").alias("path"), "at")
    canonical = F.regexp_replace("url", r"^https?://", "") == F.col("path")
    return rows.groupBy("path").agg(F.min_by("url", F.struct(~canonical, F.col("at"))).alias("url"))


def verse_labels_only(posts: DataFrame, pattern: str = r"(?i)naat|hamd|manqa?bat|salaam?|qa[sc]ee?da|kalaa?m|durood") -> DataFrame:
    """Posts whose labels name a form of verse, or that have none."""
    return posts.where((F.coalesce(F.size("labels"), F.lit(0)) <= 0) | F.exists("labels", lambda x: x.rlike(pattern)))


def image_urls(posts: DataFrame, html: str = "html", key: str = "link") -> DataFrame:
    """(key, url, position): images of a post, of each the original size if the post has it, in order of first sight."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)(?:src|href)\s*=\s*["'](http[^"'\s]+\.(?:jpe?g|png|gif|webp))["']"""), F.lit(1))
    each = posts.select(key, F.posexplode(found).alias("at", "raw")).withColumn("url", X.normalize_url(F.col("raw"))).withColumn("original", X.original_image(F.col("url")))
    best = each.groupBy(key, "original").agg(F.min_by("url", F.struct(F.col("url") != F.col("original"), "at")).alias("url"), F.min("at").alias("position"))
    return best.select(key, "url", "position")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored files that are PDFs by their first bytes; their text layer needs a reader that is not part of this package."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "length", "content")


#: Image kinds that are sent as they are, by their first bytes, and the largest such file; fixed values.
IMAGE_KINDS = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("52494646........57454250", "image/webp"))
MOST_IMAGE_BYTES = 6 * 1024 * 1024


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, mime, as_is, content) of stored scans that are images by their first bytes; as_is: small enough to be sent unchanged."""
    head = F.hex(F.substring("content", 1, 12))
    mime = F.coalesce(*[F.when(head.rlike(f"^{opening}"), kind) for opening, kind in IMAGE_KINDS])
    rows = spark.read.format("binaryFile").load(path).withColumn("mime", mime).where(F.col("mime").isNotNull())
    return rows.select("path", "length", "mime", (F.col("length") <= MOST_IMAGE_BYTES).alias("as_is"), "content")


def listing_posts(listings: DataFrame, pages: DataFrame, host: str) -> DataFrame:
    """(link, title, lyrics) of the posts that a host's listing pages (html) name and that are stored in pages (url, html); those without text are left out."""
    links = listings.select(F.explode(Q.links_of_listing("html")).alias("link")).where(X.same_host(F.col("link"), F.lit(host)) & (X.safe_source_url(F.col("link")) != "")).distinct()
    named = pages.join(links, pages["url"] == links["link"]).select("link", Q.posts_of_entries("html").alias("post"))
    return named.select("link", "post.title", "post.lyrics").where(X.blank(F.col("lyrics")) != "")


def post_texts(posts: DataFrame) -> DataFrame:
    """posts (title, html and others) with their verse as lyrics in place of html."""
    return posts.withColumn("lyrics", Q.post_bodies("html", "title")).drop("html")


#: Parser of each kind of source: a function from stored pages to (link, title, html, labels).
PARSERS: dict[str, Callable[..., DataFrame]] = {"wordpress": uniform_posts, "blogger": feed_posts, "bundle": bundle_records, "sitemap": sitemap_urls}


def platform(html: str = "html"):
    return F.when(F.contains(html, F.lit("/wp-json")), "wordpress").when(F.contains(html, F.lit("blogger")), "blogger").otherwise("html")
