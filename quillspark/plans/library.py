"""Queries of the library: listings, facets, joins and aggregates over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import glyphs as G
from ..operators import relations as R
from ..operators import search as S
from ..operators.checkpoints import cut
from .models import BRIDGE, DOCS, WORKS, Reader, bridge, documents, fold_sql, works
from .registry import query

QUERY_TEXT = "the and"


@query("search_listing", f"WITH {DOCS}, scoped AS (SELECT * FROM docs WHERE review_state = 'approved' AND contains({fold_sql('lyrics')}, 'the') AND contains({fold_sql('lyrics')}, 'and')) SELECT id, lang, source, n_chars, (SELECT count(*) FROM scoped) AS total FROM scoped ORDER BY n_chars DESC, id LIMIT 24")
def search_listing(read: Reader) -> DataFrame:
    """Visible works that have every term, the first page of 24, with the number of all."""
    scope = S.visible(documents(read)).withColumn("search_text", X.fold(F.col("lyrics")))
    found = scope.where(S.matches_all(F.col("search_text"), QUERY_TEXT)).select("id", "lang", "source", "n_chars")
    found = cut(found)  # the texts are folded once, for the page and for the number
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("n_chars"), "id").limit(24).crossJoin(F.broadcast(total))  # one row


@query("search_language_facet", f"WITH {DOCS} SELECT lang, count(DISTINCT id) AS n FROM docs WHERE review_state = 'approved' AND contains({fold_sql('lyrics')}, 'the') GROUP BY lang")
def search_language_facet(read: Reader) -> DataFrame:
    scope = S.visible(documents(read)).where(S.matches_all(X.fold(F.col("lyrics")), "the"))
    return S.facet(scope, "lang")


@query("suggest", f"WITH {DOCS}, hit AS (SELECT id, substr({fold_sql('lyrics')}, 1, 40) AS title FROM docs WHERE review_state = 'approved' AND contains({fold_sql('lyrics')}, 'tion')) SELECT id, title, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY title, id LIMIT 8")
def suggest(read: Reader) -> DataFrame:
    rows = S.visible(documents(read)).withColumn("search_text", X.fold(F.col("lyrics"))).withColumn("title", F.substring("search_text", 1, 40))
    return S.suggest(rows, "tion")


@query("keyword_search", "SELECT c_custkey, c_name FROM customer WHERE (contains(upper(c_name), '00001') OR contains(upper(c_mktsegment), '00001')) AND (contains(upper(c_name), 'BUILD') OR contains(upper(c_mktsegment), 'BUILD'))")
def keyword_search(read: Reader) -> DataFrame:
    return S.keyword_search(read("customer"), ["c_name", "c_mktsegment"], "00001 build").select("c_custkey", "c_name")


@query("iexact_filter", f"WITH {WORKS} SELECT id, language, author FROM works WHERE upper(language) = upper('urgent') AND upper(dedication) = upper('nation_3')")
def iexact_filter(read: Reader) -> DataFrame:
    return works(read).where(S.same_text(F.col("language"), "urgent") & S.same_text(F.col("dedication"), "nation_3")).select("id", "language", "author")


@query("tags_all_of", f"WITH {WORKS}, {BRIDGE} SELECT id, author FROM works w WHERE EXISTS (SELECT 1 FROM bridge WHERE work_id = id AND upper(tag) = 'BRAND#4') AND EXISTS (SELECT 1 FROM bridge WHERE work_id = id AND upper(tag) = 'BRAND#7')")
def tags_all_of(read: Reader) -> DataFrame:
    return S.with_all_tags(works(read), bridge(read), ["brand#4", "BRAND#7", "Brand#4"]).select("id", "author")


@query("tag_facet", f"WITH {WORKS}, {BRIDGE} SELECT tag, count(DISTINCT id) AS n FROM works JOIN bridge ON id = work_id WHERE review_state = 'approved' GROUP BY tag")
def tag_facet(read: Reader) -> DataFrame:
    scope = S.visible(works(read)).select("id")
    return scope.join(bridge(read), scope["id"] == F.col("work_id")).groupBy("tag").agg(F.countDistinct("id").alias("n"))


@query("author_facet_top30", f"WITH {WORKS} SELECT author, count(DISTINCT id) AS n FROM works WHERE review_state = 'approved' GROUP BY author ORDER BY n DESC, author LIMIT 30")
def author_facet_top30(read: Reader) -> DataFrame:
    return S.facet(S.visible(works(read)), "author", limit=30)


@query("scoped_facets", f"""WITH {WORKS}, base AS (SELECT *, review_state = 'approved' AS v, language = 'URGENT' AS l, dedication = 'NATION_3' AS d FROM works)
SELECT 'language' AS facet, language AS value, count(*) AS n FROM base WHERE v AND d GROUP BY language
UNION ALL SELECT 'dedication', dedication, count(*) FROM base WHERE v AND l GROUP BY dedication
UNION ALL SELECT 'author', author, count(*) FROM base WHERE v AND l AND d GROUP BY author""")
def scoped_facets(read: Reader) -> DataFrame:
    chosen = {"visible": F.col("review_state") == "approved", "language": F.col("language") == "URGENT", "dedication": F.col("dedication") == "NATION_3"}
    return S.scoped_facets(works(read), chosen, {"language": "language", "dedication": "dedication", "author": "author"})


@query("tagged_facets", f"""WITH {WORKS}, {BRIDGE}, base AS (SELECT *, review_state = 'approved' AS v, language = 'URGENT' AS l FROM works WHERE id IN (SELECT work_id FROM bridge WHERE tag = 'Brand#4'))
SELECT 'language' AS facet, language AS value, count(*) AS n FROM base WHERE v GROUP BY language
UNION ALL SELECT 'author', author, count(*) FROM base WHERE v AND l GROUP BY author
UNION ALL SELECT 'tag', tag, count(DISTINCT id) FROM base JOIN bridge ON id = work_id WHERE v AND l GROUP BY tag""")
def tagged_facets(read: Reader) -> DataFrame:
    chosen = {"visible": F.col("review_state") == "approved", "language": F.col("language") == "URGENT"}
    return S.tagged_facets(works(read), bridge(read), ["brand#4"], chosen, {"language": "language", "author": "author"})


@query("rebuilt_text", """WITH g AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_linenumber AS nth, l_returnflag AS glyph, l_quantity::DOUBLE * 2 AS x0, l_quantity::DOUBLE * 2 + l_partkey % 3 AS x1, round_even(l_suppkey % 3 + 0.5, 0) AS r FROM lineitem),
m AS (SELECT *, median(CASE WHEN x1 > x0 THEN x1 - x0 END) OVER (PARTITION BY doc, page, r) AS w, lag(x0) OVER (PARTITION BY doc, page, r ORDER BY x0 DESC, nth, x1, glyph) AS before FROM g),
t AS (SELECT doc, page, r, trim(string_agg(CASE WHEN before - x1 > w * 0.3 THEN ' ' ELSE '' END || glyph, '' ORDER BY x0 DESC, nth, x1, glyph)) AS line FROM m WHERE w IS NOT NULL GROUP BY ALL)
SELECT doc, page, string_agg(line, chr(10) ORDER BY r) AS text FROM t GROUP BY ALL""")
def rebuilt_text(read: Reader) -> DataFrame:
    """Line items as glyphs: their places come from quantity and supplier, their widths from the part."""
    x0 = F.col("l_quantity").cast("double") * 2
    y0 = (F.col("l_suppkey") % 3).cast("double")
    glyphs = read("lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("glyph"),
        x0.alias("x0"), (x0 + F.col("l_partkey") % 3).alias("x1"), y0.alias("y0"), (y0 + 1).alias("y1"),
    )
    return G.rebuilt_text(glyphs, ["doc", "page"])


@query("grouped_axes", f"WITH {BRIDGE}, counts AS (SELECT axis, tag, count(DISTINCT work_id) AS n FROM bridge GROUP BY axis, tag) SELECT axis, sum(n)::BIGINT AS total, string_agg(tag || '=' || n, ',' ORDER BY n DESC, tag) AS items FROM counts GROUP BY axis")
def grouped_axes(read: Reader) -> DataFrame:
    counts = bridge(read).groupBy("axis", "tag").agg(F.countDistinct("work_id").alias("n"))
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), lambda x: F.concat(x["tag"], F.lit("="), -x["m"]))
    return counts.groupBy("axis").agg(F.sum("n").alias("total"), F.array_join(items, ",").alias("items"))


@query("filtered_count_having", f"WITH {WORKS} SELECT author, count(*) FILTER (WHERE review_state = 'approved') AS n FROM works GROUP BY author HAVING count(*) FILTER (WHERE review_state = 'approved') > 3")
def filtered_count_having(read: Reader) -> DataFrame:
    return works(read).groupBy("author").agg(F.count_if(F.col("review_state") == "approved").alias("n")).where("n > 3")


@query("child_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_works, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer")
def child_counts(read: Reader) -> DataFrame:
    return R.child_counts(read("customer").select("c_custkey"), "c_custkey", n_works=(read("orders"), "o_custkey"), n_events=(read("events"), "user_id"))


@query("prefetch_tags", f"WITH {WORKS}, {BRIDGE} SELECT w.id, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM works w LEFT JOIN bridge ON id = work_id GROUP BY w.id")
def prefetch_tags(read: Reader) -> DataFrame:
    lists = bridge(read).groupBy("work_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))
    w = works(read).select("id")
    return w.join(lists, w["id"] == lists["work_id"], "left").select("id", F.coalesce("tags", F.lit("")).alias("tags"))


@query("semi_join_scope", f"WITH {WORKS} SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT id FROM works WHERE review_state = 'approved' AND language = 'LOW')")
def semi_join_scope(read: Reader) -> DataFrame:
    scope = S.visible(works(read)).where("language = 'LOW'").select("id")
    li = read("lineitem").select("l_orderkey", "l_linenumber")
    return li.join(scope, li["l_orderkey"] == scope["id"], "left_semi")


@query("untagged_works", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def untagged_works(read: Reader) -> DataFrame:
    o, li = read("orders").select("o_orderkey"), read("lineitem").select("l_orderkey")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti")


@query("missing_details", f"""WITH {DOCS} SELECT 'approved' AS gap, count(*) AS n FROM docs WHERE review_state <> 'approved' UNION ALL SELECT 'text', count(*) FROM docs WHERE lyrics = '' UNION ALL SELECT 'label', count(*) FROM docs WHERE id NOT IN (SELECT doc_id FROM labels)""")
def missing_details(read: Reader) -> DataFrame:
    """Works with each gap; one pass over the works."""
    d = documents(read)
    lb = read("labels").select(F.col("doc_id").alias("_d")).distinct().withColumn("_has", F.lit(True))
    row = d.join(lb, d["id"] == lb["_d"], "left").agg(F.count_if(F.col("review_state") != "approved").alias("approved"), F.count_if(F.col("lyrics") == "").alias("text"), F.count_if(F.col("_has").isNull()).alias("label"))
    return row.unpivot([], ["approved", "text", "label"], "gap", "n")


@query("page_two", f"WITH {WORKS} SELECT id, author, price FROM works WHERE review_state = 'approved' ORDER BY created_at DESC, id LIMIT 24 OFFSET 24")
def page_two(read: Reader) -> DataFrame:
    return S.page(S.visible(works(read)).select("id", "author", "price", "created_at"), [F.desc("created_at"), F.asc("id")], 2).select("id", "author", "price")


@query("featured_longest", f"WITH {DOCS}, top AS (SELECT lang FROM docs WHERE review_state = 'approved' GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2), ranked AS (SELECT id, lang, length(lyrics) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(lyrics) DESC, id) AS r FROM docs WHERE review_state = 'approved' AND text_quality = 'ok' AND lang IN (SELECT lang FROM top)) SELECT id, lang, n, r::INTEGER AS r FROM ranked WHERE r <= 3")
def featured_longest(read: Reader) -> DataFrame:
    shown = S.visible(documents(read))
    top = shown.groupBy("lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "lang").limit(2).select(F.col("lang").alias("tl"))
    clean = shown.where("text_quality = 'ok'").select("id", "lang", F.length("lyrics").alias("n"))
    scope = clean.join(F.broadcast(top), clean["lang"] == top["tl"], "left_semi")  # two rows
    return scope.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "id"))).where("r <= 3")


@query("statistics", f"WITH {WORKS} SELECT count(*) FILTER (WHERE review_state = 'approved') AS works, count(DISTINCT author_id) AS poets, count(DISTINCT language) AS languages, count(*) FILTER (WHERE review_state = 'pending') AS pending FROM works")
def statistics(read: Reader) -> DataFrame:
    return works(read).agg(F.count_if(F.col("review_state") == "approved").alias("works"), F.countDistinct("author_id").alias("poets"), F.countDistinct("language").alias("languages"), F.count_if(F.col("review_state") == "pending").alias("pending"))


@query("coalesced_dates", f"WITH {WORKS} SELECT id, coalesce(CASE WHEN review_state = 'approved' THEN created_at END, TIMESTAMP '2000-01-01') AS shown_at, CASE WHEN price > 100000 THEN 'long' WHEN price > 50000 THEN 'middle' ELSE 'short' END AS band FROM works")
def coalesced_dates(read: Reader) -> DataFrame:
    shown = F.coalesce(F.when(F.col("review_state") == "approved", F.col("created_at")), F.lit("2000-01-01").cast("timestamp_ntz"))
    w = works(read)
    return w.select("id", shown.cast(w.schema["created_at"].dataType).alias("shown_at"), F.when(F.col("price") > 100000, "long").when(F.col("price") > 50000, "middle").otherwise("short").alias("band"))


@query("bulk_review", f"WITH {WORKS} SELECT id, CASE WHEN review_state = 'pending' AND language = 'HIGH' THEN 'approved' ELSE review_state END AS review_state, review_state = 'pending' AND language = 'HIGH' AS changed FROM works")
def bulk_review(read: Reader) -> DataFrame:
    """A predicate update; rows that change are marked, so that only they need to be written."""
    hit = (F.col("review_state") == "pending") & (F.col("language") == "HIGH")
    return works(read).select("id", F.when(hit, "approved").otherwise(F.col("review_state")).alias("review_state"), hit.alias("changed"))


@query("dimension_lookup", "SELECT s_suppkey, c_custkey AS poet_id FROM (SELECT s_suppkey, replace(s_name, 'Supplier', 'CUSTOMER') AS name FROM supplier) LEFT JOIN customer ON lower(trim(name)) = lower(c_name)")
def dimension_lookup(read: Reader) -> DataFrame:
    rows = read("supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER")).alias("poet"))
    found, _ = R.lookup_or_new(rows, read("customer"), "poet", "c_custkey", "c_name")
    return found.select("s_suppkey", "poet_id")


@query("names_from_text", "SELECT min(trim(c_mktsegment)) AS name, count(*) AS n FROM customer GROUP BY lower(trim(c_mktsegment))")
def names_from_text(read: Reader) -> DataFrame:
    return R.names_from_text(read("customer"), "c_custkey", "c_mktsegment")


@query("replacement_chase", """WITH RECURSIVE hops AS (
  SELECT o_orderkey AS id, o_orderkey AS cur, 0 AS hop FROM orders
  UNION ALL SELECT h.id, h.cur // 2, hop + 1 FROM hops h WHERE hop < 5 AND h.cur % 10 <> 0 AND h.cur IN (SELECT o_orderkey FROM orders)
)
SELECT o.o_orderkey AS id, (SELECT h.cur FROM hops h JOIN orders v ON v.o_orderkey = h.cur WHERE h.id = o.o_orderkey AND hop > 0 AND v.o_orderstatus = 'O' ORDER BY hop LIMIT 1) AS target FROM orders o""")
def replacement_chase(read: Reader) -> DataFrame:
    """The first visible work within five hops of replaced_by."""
    n = read("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    links = n.select("id", F.when(F.col("id") % 10 != 0, F.expr("id div 2")).alias("replaced_by_id"))
    return R.follow(links, n.select("id"), n.where("o_orderstatus = 'O'"))


@query("collection_numbering", "SELECT o_orderkey, o_custkey, 2 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'P'")
def collection_numbering(read: Reader) -> DataFrame:
    o = read("orders").select("o_orderkey", F.col("o_custkey").alias("collection_id"), "o_orderstatus")
    parts = o.select("collection_id").distinct().withColumn("position", F.lit(2))
    out = R.numbered_after(parts, o.where("o_orderstatus = 'P'"), ["o_orderkey"])
    return out.select("o_orderkey", F.col("collection_id").alias("o_custkey"), F.col("position").cast("long").alias("position"))


@query("sitemap_pages", f"WITH {WORKS} SELECT id, CASE WHEN language = 'URGENT' THEN '0.9' ELSE '0.5' END AS priority, ((row_number() OVER (ORDER BY id) - 1) // 2000)::BIGINT AS section FROM works WHERE review_state = 'approved'")
def sitemap_pages(read: Reader) -> DataFrame:
    """Entries of sitemap sections of 2,000: a range sort numbers the rows, no task sees all of them."""
    own = S.visible(works(read)).select("id", F.when(F.col("language") == "URGENT", "0.9").otherwise("0.5").alias("priority"))
    return R.numbered(own, ["id"], "rn").select("id", "priority", F.floor(F.col("rn") / 2000).alias("section"))


@query("my_library", "SELECT user_id, count(*) AS saves, max(ts) AS newest FROM events WHERE event_type = 'signup' AND value > 10 GROUP BY user_id HAVING count(*) > 2")
def my_library(read: Reader) -> DataFrame:
    return read("events").where("event_type = 'signup' AND value > 10").groupBy("user_id").agg(F.count("*").alias("saves"), F.max("ts").alias("newest")).where("saves > 2")


@query("date_drill_down", "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def date_drill_down(read: Reader) -> DataFrame:
    o = read("orders").where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))


@query("tag_union_distinct", f"WITH {BRIDGE} SELECT work_id, tag FROM bridge WHERE axis = 'PROMO' UNION SELECT work_id, 'kept' FROM bridge WHERE axis = 'SMALL'")
def tag_union_distinct(read: Reader) -> DataFrame:
    b = bridge(read)
    return b.where("axis = 'PROMO'").select("work_id", "tag").union(b.where("axis = 'SMALL'").select("work_id", F.lit("kept"))).distinct()


@query("null_order", "SELECT id, position FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS position FROM orders) ORDER BY position ASC NULLS LAST, id")
def null_order(read: Reader) -> DataFrame:
    o = read("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).alias("position"))
    return o.orderBy(F.asc_nulls_last("position"), "id")


@query("status_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS waiting, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE value IS NULL) AS unattributed FROM events GROUP BY user_id")
def status_counts(read: Reader) -> DataFrame:
    return read("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("waiting"), F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count_if(F.col("value").isNull()).alias("unattributed"))


@query("random_work")
def random_work(read: Reader) -> DataFrame:
    return S.visible(works(read)).orderBy(F.rand()).limit(1).select("id", "author")


@query("json_suggest", "SELECT json_object('id', c_custkey, 'name', c_name)::VARCHAR AS line FROM customer")
def json_suggest(read: Reader) -> DataFrame:
    return read("customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("line"))
