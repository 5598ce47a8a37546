"""Joins, aggregates, windows and upserts that the library's queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def child_lists(children: DataFrame, key: str, fields: list[str], out: str = "items") -> DataFrame:
    """Each parent's children as a sorted array."""
    return children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def child_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Numbers of several kinds of children, none counted as zero. Each kind is counted before the join, so none multiplies another."""
    out = parents
    for name, (rows, foreign) in children.items():
        counted = rows.groupBy(F.col(foreign).alias("_f")).agg(F.count("*").alias(name))
        out = out.join(counted, out[key] == counted["_f"], "left").drop("_f").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def lookup_or_new(rows: DataFrame, dimension: DataFrame, name: str, dim_id: str = "id", dim_name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(rows with the id of the dimension row of that name whatever the case, the first spelling of each new name)."""
    key = F.lower(X.strip(X.blank(F.col(name))))
    known = dimension.groupBy(F.lower(dim_name).alias("_n")).agg(F.min(dim_id).alias(f"{name}_id"))
    keyed = rows.withColumn("_key", F.nullif(key, F.lit("")))
    found = keyed.join(known, keyed["_key"] == known["_n"], "left").drop("_n")
    fresh = found.where(F.col(f"{name}_id").isNull() & F.col("_key").isNotNull()).groupBy("_key").agg(F.min(X.strip(F.col(name))).alias("name"))
    return found.drop("_key"), fresh.select("name")


def names_from_text(rows: DataFrame, id_: str, column: str) -> DataFrame:
    """(name, rows) of a free-text column: values that differ in case or outer space are one, spelled as in its first row."""
    key = F.lower(X.strip(F.col(column)))
    return rows.where(X.strip(X.blank(F.col(column))) != "").groupBy(key.alias("k")).agg(F.min_by(X.strip(F.col(column)), F.col(id_)).alias("name"), F.count("*").alias("n")).drop("k")


def follow(links: DataFrame, start: DataFrame, visible: DataFrame, most: int = 5) -> DataFrame:
    """(id, target): the first visible work reached from each start by replaced_by, in at most `most` hops."""
    hop = links.select(F.col("id").alias("_from"), F.col("replaced_by_id").alias("_to"))
    shown = visible.select(F.col("id").alias("_seen")).withColumn("_ok", F.lit(True))
    now = start.select("id", F.col("id").alias("at")).withColumn("target", F.lit(None).cast(start.schema["id"].dataType))
    for _ in range(most):
        now = now.join(hop, now["at"] == hop["_from"], "left").select("id", F.when(F.col("target").isNull(), F.col("_to")).alias("at"), "target")
        now = now.join(shown, now["at"] == shown["_seen"], "left").select("id", "at", F.coalesce("target", F.when(F.col("_ok"), F.col("at"))).alias("target"))
    return now.select("id", "target")


def newest_per_key(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= keep).drop("_rank")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with row numbers from 0 in the order. Rows are sorted by range and numbered within partitions; the counts of
    the partitions, one row each, give the offsets, so no task sees all rows."""
    from .checkpoints import cut

    placed = cut(df.orderBy(*order).withColumn("_at", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = placed.groupBy("_at").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_at", "_before")
    inside = F.col("_id") - F.shiftleft(F.col("_at").cast("long"), 33)
    return placed.join(F.broadcast(before), "_at").withColumn(out, F.col("_before") + inside).drop("_at", "_id", "_before")


def numbered_after(parts: DataFrame, newcomers: DataFrame, order: list[str]) -> DataFrame:
    """Newcomers of a collection with positions after its greatest."""
    top = parts.groupBy("collection_id").agg(F.max("position").alias("_top"))
    numbered = newcomers.withColumn("_n", F.row_number().over(Window.partitionBy("collection_id").orderBy(*order)))
    return numbered.join(top, "collection_id", "left").withColumn("position", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_top", "_n")


def collections_of(works: DataFrame) -> DataFrame:
    """(base, parts): titles of the same base with part numbers, two at least; the base is spelled as in the first part."""
    rows = works.withColumn("p", X.series_part(F.col("title"))).where(F.col("p.base").isNotNull())
    return rows.groupBy(F.lower("p.base").alias("k")).agg(F.min_by("p.base", F.struct("p.n", "id")).alias("base"), F.count("*").alias("parts")).where("parts >= 2").select("base", "parts")


def request_slots(requests: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """When each request may go out if a host's requests keep a distance: the later of its time and the last slot plus the distance."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    gap = int(seconds * 1_000_000)
    n = F.row_number().over(w).cast("long") * gap
    asked = F.unix_micros(at)
    free = F.max(asked - n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.withColumn("_n", n).withColumn("slot", F.timestamp_micros(free + n)).drop("_n")


def refusal_runs(attempts: DataFrame, key: str, order: list[str], refused: Column, answered: Column) -> DataFrame:
    """Refusals in a row up to each attempt; an answer begins anew, other failures leave the run alone."""
    w = Window.partitionBy(key).orderBy(*order)
    island = attempts.withColumn("_island", F.sum(answered.cast("int")).over(w))
    inside = Window.partitionBy(key, "_island").orderBy(*order)
    return island.withColumn("in_a_row", F.sum(refused.cast("int")).over(inside)).drop("_island")


def throttled(attempts: DataFrame, key: str, order: list[str], refused: Column, answered: Column, pause: int = 30, most: int = 6) -> DataFrame:
    """The attempts that take place, with in_a_row and the seconds to wait after each: refusals in a row lengthen the
    pause, and the one numbered `most` ends the key's run."""
    runs = refusal_runs(attempts, key, order, refused, answered)
    earlier = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    going = runs.withColumn("_worst", F.max("in_a_row").over(earlier)).where(F.coalesce("_worst", F.lit(0)) < most).drop("_worst")
    return going.withColumn("pause", F.when(refused & (F.col("in_a_row") < most), F.col("in_a_row") * pause).otherwise(0).cast("long"))


def prefer(df: DataFrame, key: list[str], value: str, order: list[Column]) -> DataFrame:
    """One value of each key: the first in the order."""
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def usage_by_day(calls: DataFrame, at: str = "ts", model: str = "model", hours: int = 4) -> DataFrame:
    """Calls and tokens of each day and model, days beginning at UTC + hours."""
    day = F.to_date(F.col(at) + F.make_dt_interval(hours=F.lit(hours)))
    return calls.groupBy(day.alias("day"), F.col(model).alias("model")).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def usage_report(usage: DataFrame) -> DataFrame:
    """One row for each day with a map of its models."""
    entry = F.struct("model", F.struct("calls", "tokens_in", "tokens_out"))
    return usage.groupBy("day").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("models"))


def upsert_counts(current: DataFrame, events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """(keys, last_read_at, read_count) after the events are added to the current rows."""
    new = events.groupBy(*keys).agg(F.max(at).alias("last_read_at"), F.count("*").alias("read_count"))
    both = current.select(*keys, "last_read_at", "read_count").unionByName(new)
    return both.groupBy(*keys).agg(F.max("last_read_at").alias("last_read_at"), F.sum("read_count").alias("read_count"))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose toggle stands on: an odd number of events."""
    return events.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys)


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """A map of the fields whose submitted text differs, line ends made alike."""
    names = list(new)
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.struct(X.submitted(old[n]).alias("old"), X.submitted(new[n]).alias("new")))])
    return F.transform_values(F.map_filter(pairs, lambda _, v: v["old"] != v["new"]), lambda _, v: v["new"])


def filled(old: Column, draft: Column, overwrite: bool = False, protected: Column | None = None) -> Column:
    """The draft where the old text is blank, or anywhere if overwriting, but never where protected."""
    take = (X.blank(draft) != "") & (F.lit(overwrite) | (X.strip(X.blank(old)) == ""))
    return F.when(take & ~(protected if protected is not None else F.lit(False)), draft).otherwise(old)


def reconcile_sources(defaults: DataFrame, table: DataFrame) -> DataFrame:
    """The source table with missing defaults added, names and parsers of known ones updated, and is_active kept."""
    d = defaults.select(F.col("url").alias("du"), F.col("name").alias("dn"), F.col("parser_type").alias("dp"))
    joined = table.join(d, table["url"] == d["du"], "full_outer")
    return joined.select(F.coalesce("url", "du").alias("url"), F.coalesce("dn", "name").alias("name"), F.coalesce("dp", "parser_type").alias("parser_type"), F.coalesce("is_active", F.lit(True)).alias("is_active"))


def crawl_frontier(pages: DataFrame, seeds: DataFrame, skip: str, levels: int = 3, budget: int | None = None) -> DataFrame:
    """(url, level) reached breadth first from the seeds over links of the same host; one anti-join a level.

    The reached set is cut from its lineage each level, so plans do not grow with the depth.
    """
    from .checkpoints import cut

    href = F.regexp_extract_all(F.col("html"), F.lit(r'(?i)<a\s[^>]*href="([^"#]+)"'), F.lit(1))
    edges = pages.select(F.col("url").alias("src"), X.host(F.col("url")).alias("h"), F.explode(href).alias("href"))
    base = F.regexp_extract("src", "^([a-z]+://[^/]+)", 1)
    edges = edges.withColumn("url", F.when(F.col("href").startswith("/"), F.concat(base, F.col("href"))).otherwise(F.col("href")))
    edges = cut(edges.where(X.same_host(F.col("url"), F.col("h")) & ~F.col("url").rlike(skip)).select("src", "url").distinct())
    reached = cut(seeds.select("url").distinct().withColumn("level", F.lit(0)))
    front = reached
    for level in range(1, levels + 1):
        new = edges.join(front.select(F.col("url").alias("src")), "src").select("url").distinct().join(reached, "url", "left_anti")
        front = cut(new.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front))
    return reached.orderBy("level", "url").limit(budget) if budget else reached
