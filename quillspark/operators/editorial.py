"""Editorial transitions as batch transforms. A decision is taken once: decided rows do not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PROPOSED = ("title", "native_title", "author", "language", "lyrics", "transliteration", "translation")


def apply_suggestions(works: DataFrame, suggestions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(works, suggestions) after the undecided accepted suggestions are applied, the latest id last; blank proposals change nothing."""
    open_ = suggestions.where(~F.col("is_reviewed") & F.col("accept"))
    given = [F.max_by(F.nullif(X.strip(X.blank(F.col(f"proposed_{c}"))), F.lit("")), F.when(X.strip(X.blank(F.col(f"proposed_{c}"))) != "", F.col("id"))).alias(f"_{c}") for c in PROPOSED]
    last = open_.groupBy(F.col("work_id").alias("_w")).agg(*given)
    joined = works.join(last, works["id"] == last["_w"], "left")
    out = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in PROPOSED else F.col(c) for c in works.columns])
    decided = suggestions.withColumns({
        "is_approved": F.when(F.col("is_reviewed"), F.col("is_approved")).otherwise(F.coalesce("accept", F.lit(False))),
        "reviewed_at": F.when(F.col("is_reviewed") | F.col("accept").isNull(), F.col("reviewed_at")).otherwise(now),
        "is_reviewed": F.col("is_reviewed") | F.col("accept").isNotNull(),
    })
    return out, decided


def publish_contributions(contributions: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(new works, contributions): pending accepted submissions become works, numbered from next_id in order of ids."""
    from .relations import numbered

    fresh = contributions.where("status = 'pending' AND kind = 'submission' AND accept")
    works = numbered(fresh, ["id"], "_n").select((F.col("_n") + next_id).alias("id"), F.substring("title", 1, 200).alias("title"), "lyrics", F.lit("approved").alias("review_state"), F.col("id").alias("contribution_id"))
    published = works.select(F.col("contribution_id").alias("_c"), F.col("id").alias("_as"))
    joined = contributions.join(published, contributions["id"] == published["_c"], "left")
    state = F.when(F.col("status") != "pending", F.col("status")).when(F.col("accept"), "accepted").when(~F.col("accept"), "declined").otherwise("pending")
    return works, joined.withColumns({"published_as": F.coalesce("_as", "published_as"), "status": state}).drop("_c", "_as")


def set_state(works: DataFrame, chosen: Column, state: str, now: Column) -> DataFrame:
    """Bulk approve, reject or put back to pending; reviewed_at is cleared for pending."""
    change = chosen & (F.col("review_state") != state)
    return works.withColumns({"reviewed_at": F.when(change, F.lit(None).cast("timestamp") if state == "pending" else now).otherwise(F.col("reviewed_at")), "review_state": F.when(change, state).otherwise(F.col("review_state"))})


def refile_tags(tags: DataFrame) -> DataFrame:
    """Tags with the axis that their names give."""
    return tags.withColumn("category", X.tag_axis(F.col("name")))


def suspend(accounts: DataFrame, chosen: Column, me: int, superuser: bool) -> DataFrame:
    """Chosen accounts made inactive: never one's own, superusers only by a superuser."""
    may = chosen & (F.col("id") != me) & (F.lit(superuser) | ~F.col("is_superuser"))
    return accounts.withColumn("is_active", F.col("is_active") & ~may)


def job(df: DataFrame, column: str, change: Callable[[Column], Column], guard: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(changed rows with before and after, counts by outcome) of a batch text job: a dry run shows them, a real one
    writes the changed rows. The guard refuses changes that lose content."""
    rows = df.withColumn("after", change(F.col(column)))
    differs = F.col("after") != F.col(column)
    fine = guard(F.col(column), F.col("after")) if guard else F.lit(True)
    outcome = F.when(~F.coalesce(differs, F.lit(False)), "unchanged").when(~fine, "refused").otherwise("changed")
    rows = rows.withColumn("outcome", outcome)
    return rows.where("outcome = 'changed'").withColumnRenamed(column, "before"), rows.groupBy("outcome").agg(F.count("*").alias("n"))


def tidy_lyrics(works: DataFrame, column: str = "lyrics") -> tuple[DataFrame, DataFrame]:
    """Page apparatus stripped from texts that are a fifth of it or more, if nine tenths of the Arabic stay."""
    return job(works, column, lambda c: F.when(X.furniture_ratio(c) >= X.FURNITURE_RATIO, X.strip_furniture(c)).otherwise(c), lambda a, _: X.furniture_is_safe(a))


def tidy_markers(works: DataFrame, column: str = "lyrics") -> tuple[DataFrame, DataFrame]:
    return job(works, column, X.verse_markers)


def reflow_lyrics(works: DataFrame, column: str = "lyrics") -> tuple[DataFrame, DataFrame]:
    """Collapsed pages broken into lines where any line is over the limit; only white space may change."""
    long = lambda c: F.exists(X.lines(c), lambda x: F.length(X.strip(x)) > X.MEGA_LINE)
    return job(works, column, lambda c: F.when(long(c), X.reflow(c)).otherwise(c), X.same_characters)


def split_translations(works: DataFrame, least: int = 80) -> DataFrame:
    """(id, original, translation) of texts with over a hundred letters of both scripts and no translation yet, if both sides are long enough."""
    mixed = works.where((X.arabic_length(F.col("lyrics")) > 100) & (X.count(F.col("lyrics"), X.LATIN) > 100) & (X.blank(F.col("translation")) == ""))
    parts = mixed.select("id", X.split_by_script(F.col("lyrics")).alias("s"))
    return parts.select("id", "s.original", "s.translation").where((F.length("original") >= least) & (F.length("translation") >= least))


def present_layers(lyrics: Column, transliteration: Column, translation: Column) -> Column:
    """Names of the layers with their sizes, for a heading."""
    part = lambda n, c: F.when(X.strip(X.blank(c)) != "", F.concat(F.lit(f"{n} ("), F.length(X.strip(c)), F.lit(")")))
    return F.array_join(F.array_compact(F.array(part("lyrics", lyrics), part("transliteration", transliteration), part("translation", translation))), ", ")


def shown_layer(lyrics: Column, transliteration: Column) -> Column:
    """(layer, text) that a comparison shows: lyrics, else the transliteration."""
    first = X.strip(X.blank(lyrics)) != ""
    return F.struct(F.when(first, "lyrics").otherwise("transliteration").alias("layer"), F.when(first, lyrics).otherwise(X.blank(transliteration)).alias("text"))


def proposal_labels(**proposed: Column) -> Column:
    """Labels of the fields that a suggestion changes; `Report only` for a note alone."""
    names = F.array_compact(F.array(*[F.when(X.strip(X.blank(c)) != "", n.replace("_", " ").capitalize()) for n, c in proposed.items()]))
    return F.when(F.size(names) == 0, "Report only").otherwise(F.array_join(names, ", "))


def decision_counts(rows: DataFrame, decided: Column) -> DataFrame:
    return rows.agg(F.count_if(decided).alias("done"), F.count_if(~decided).alias("skipped"))


def confirmed_holders(profiles: DataFrame, unconfirmed: DataFrame, email: str) -> DataFrame:
    """Accounts that hold a confirmed address."""
    return profiles.where(F.lower("email") == email.lower()).join(unconfirmed, profiles["user_id"] == unconfirmed["id"], "left_anti")
