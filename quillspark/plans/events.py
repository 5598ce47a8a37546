"""Queries over reader events: histories, toggles, slots, runs, limits, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import limits as M
from ..operators import relations as R
from .models import Reader
from .registry import query


@query("reading_history", "SELECT user_id, value::BIGINT % 500 AS work_id, max(ts) AS last_read_at, count(*) AS read_count FROM events WHERE event_type = 'view' GROUP BY ALL")
def reading_history(read: Reader) -> DataFrame:
    ev = read("events").where("event_type = 'view'").select("user_id", (F.rint("value").cast("long") % 500).alias("work_id"), "ts")
    return R.upsert_counts(ev.select("user_id", "work_id", F.col("ts").alias("last_read_at"), F.lit(1).cast("long").alias("read_count")).limit(0), ev, ["user_id", "work_id"])


@query("history_trim", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 20")
def history_trim(read: Reader) -> DataFrame:
    return R.newest_per_key(read("events"), "user_id", [F.desc("ts"), F.asc("event_id")], 20).select("user_id", "event_id")


@query("favourites", "SELECT user_id, value::BIGINT % 50 AS work_id FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1")
def favourites(read: Reader) -> DataFrame:
    ev = read("events").where("event_type = 'click'").select("user_id", (F.rint("value").cast("long") % 50).alias("work_id"))
    return R.toggled(ev, ["user_id", "work_id"])


@query("request_slots", """WITH n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 60000000 AS k FROM events)
SELECT event_id, user_id, max(t - k) OVER (PARTITION BY user_id ORDER BY k) + k AS slot FROM n""")
def request_slots(read: Reader) -> DataFrame:
    ev = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.request_slots(ev, "user_id", "ts", 60).select("event_id", "user_id", F.unix_micros("slot").alias("slot"))


@query("refusal_runs", """WITH i AS (SELECT event_id, user_id, ts, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS in_a_row FROM i""")
def refusal_runs(read: Reader) -> DataFrame:
    out = R.refusal_runs(read("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.select("event_id", "in_a_row")


@query("archive_pauses", """WITH i AS (SELECT event_id, user_id, ts, event_type, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS island FROM events),
r AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS n FROM i),
w AS (SELECT *, max(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worst FROM r)
SELECT event_id, n AS in_a_row, CASE WHEN event_type = 'error' AND n < 3 THEN n * 30 ELSE 0 END AS pause FROM w WHERE coalesce(worst, 0) < 3""")
def archive_pauses(read: Reader) -> DataFrame:
    """Events as requests to an archive that refuses some."""
    out = R.throttled(read("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", most=3)
    return out.select("event_id", "in_a_row", "pause")


@query("usage_by_day", """SELECT (ts + INTERVAL 4 HOURS)::DATE AS day, event_type AS model, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS tokens_in, sum(value::BIGINT)::BIGINT AS tokens_out FROM events GROUP BY ALL""")
def usage_by_day(read: Reader) -> DataFrame:
    calls = read("events").select(F.col("ts"), F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), F.rint("value").cast("long").alias("tokens_out"))
    return R.usage_by_day(calls)


@query("usage_report", """WITH u AS (SELECT (ts + INTERVAL 4 HOURS)::DATE AS day, event_type AS model, count(*) AS calls FROM events GROUP BY ALL)
SELECT day, string_agg(model || '=' || calls, ',' ORDER BY model) AS models FROM u GROUP BY day""")
def usage_report(read: Reader) -> DataFrame:
    calls = read("events").select("ts", F.col("event_type").alias("model"), F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))
    rows = R.usage_report(R.usage_by_day(calls))
    entries = F.array_sort(F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["calls"])))
    return rows.select("day", F.array_join(entries, ",").alias("models"))


@query("rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (
  SELECT user_id, event_id, k, t AS began, 1 AS n, TRUE AS allowed FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t >= w.began + 86400000000 THEN e.t ELSE w.began END,
    CASE WHEN e.t >= w.began + 86400000000 THEN 1 WHEN w.n < 2 THEN w.n + 1 ELSE w.n END, e.t >= w.began + 86400000000 OR w.n < 2
  FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1
)
SELECT event_id, allowed FROM w""")
def rate_limit(read: Reader) -> DataFrame:
    return M.limited(read("events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 86_400).select("event_id", "allowed")


@query("json_props", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'signup'")
def json_props(read: Reader) -> DataFrame:
    return read("events").where("event_type = 'signup'").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("changed_fields", "SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN 'language,status' ELSE 'language' END AS changed FROM orders")
def changed_fields(read: Reader) -> DataFrame:
    o = read("orders")
    old = {"language": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "key": F.col("o_orderkey").cast("string")}
    new = {"language": F.concat("o_orderpriority", F.lit("!\r\n")), "status": F.when(F.col("o_totalprice") > 50000, "x").otherwise(F.concat("o_orderstatus", F.lit(" \r"))), "key": F.col("o_orderkey").cast("string")}
    return o.select("o_orderkey", F.array_join(F.array_sort(F.map_keys(R.changed_fields(old, new))), ",").alias("changed"))


@query("filled_drafts", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'draft' ELSE s_name END AS text FROM supplier")
def filled_drafts(read: Reader) -> DataFrame:
    s = read("supplier")
    old = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise(" ")
    return s.select("s_suppkey", R.filled(old, F.lit("draft")).alias("text"))


@query("reconciled_sources", """SELECT s_name AS url, CASE WHEN s_nationkey < 15 THEN 'new' ELSE 'old' END AS name, 'html' AS parser_type, s_acctbal <= 0 OR s_acctbal < 5000 AS is_active
FROM supplier WHERE s_acctbal > 0 OR s_nationkey < 15""")
def reconciled_sources(read: Reader) -> DataFrame:
    """Suppliers in credit are the sources known so far, those of the first nations the defaults."""
    s = read("supplier")
    have = s.where("s_acctbal > 0").select(F.col("s_name").alias("url"), F.lit("old").alias("name"), F.lit("html").alias("parser_type"), (F.col("s_acctbal") < 5000).alias("is_active"))
    return R.reconcile_sources(s.where("s_nationkey < 15").select(F.col("s_name").alias("url"), F.lit("new").alias("name"), F.lit("html").alias("parser_type")), have)
