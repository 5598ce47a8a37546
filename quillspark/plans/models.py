"""The library's tables as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

Reader = Callable[[str], DataFrame]

STATES = {"O": "approved", "P": "pending", "F": "rejected"}


def works(read: Reader) -> DataFrame:
    """Orders as works: customers are poets, nations dedications, priorities languages."""
    o, c, n = read("orders"), read("customer"), read("nation")
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("o_orderstatus"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nations are 25 by definition
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"), F.col("n_name").alias("dedication"),
        F.substring("o_orderpriority", 3, 20).alias("language"), state.alias("review_state"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


WORKS = """works AS (
  SELECT o_orderkey AS id, c_custkey AS author_id, c_name AS author, n_name AS dedication, substr(o_orderpriority, 3, 20) AS language,
    CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS review_state, o_orderdate AS created_at, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def bridge(read: Reader) -> DataFrame:
    """Line items as tags of works: brands are tags, part types their axes."""
    li, p = read("lineitem"), read("part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("work_id"), F.col("p_brand").alias("tag"), F.col("p_type").alias("axis"))


BRIDGE = "bridge AS (SELECT l_orderkey AS work_id, p_brand AS tag, p_type AS axis FROM lineitem JOIN part ON l_partkey = p_partkey)"


def documents(read: Reader) -> DataFrame:
    """Documents as works with a text; labels are the review state and the text quality."""
    d, lb = read("documents"), read("labels")
    own = lb.select(F.col("doc_id").alias("_l"), "quality", "toxic")
    rows = d.join(own, d["doc_id"] == own["_l"], "left")
    state = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    return rows.select(F.col("doc_id").alias("id"), F.col("text").alias("lyrics"), "lang", "source", "n_chars", state.alias("review_state"), F.when(F.col("toxic") == 1, "poor").otherwise("ok").alias("text_quality"))


DOCS = """docs AS (
  SELECT d.doc_id AS id, text AS lyrics, lang, source, n_chars, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_state,
    CASE WHEN toxic = 1 THEN 'poor' ELSE 'ok' END AS text_quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def fold_sql(c: str) -> str:
    """SQL of the folding of a text."""
    marks = f"regexp_replace(coalesce({c}, ''), '[\\x{{064B}}-\\x{{0652}}\\x{{0653}}-\\x{{0655}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g')"
    letters = f"translate(replace({marks}, 'ﷲ', 'الله'), '{X.FOLDED_FROM}', '{X.FOLDED_TO}')"
    words = f"regexp_replace({letters}, '[^\\p{{L}}\\p{{N}}_\\s\\x{{0600}}-\\x{{06FF}}]+', ' ', 'g')"
    return f"lower(trim(regexp_replace({words}, '\\s+', ' ', 'g')))"
