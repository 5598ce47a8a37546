"""Rate limits whose window begins at the first event of a key, in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (action, limit, window in seconds) of the limits in force; fixed values.
LIMITS = (
    ("suggestion", 30, 3600), ("pdf", 20, 600), ("contact", 6, 3600), ("contribution", 20, 86_400), ("register", 10, 3600), ("reset", 3, 3600), ("reset_address", 10, 3600), ("resend", 3, 3600), ("login", 8, 900), ("login_address", 40, 900),
)


def decide(seconds: list[float], limit: int, window: float, clears: list[bool] | None = None, start: tuple[float, int] | None = None) -> tuple[list[bool], tuple[float, int] | None]:
    """Whether each event of a key, in order, is let through, and the counter (when it began, its count) afterwards.

    Only events let through are counted; a counter ends `window` seconds after its first one; a clearing event ends it.
    """
    out, counter = [], start
    for k, at in enumerate(seconds):
        if counter is not None and at >= counter[0] + window:
            counter = None
        if clears is not None and clears[k]:
            counter = None
            out.append(True)
            continue
        allowed = counter is None or counter[1] < limit
        if allowed:
            counter = (at, 1) if counter is None else (counter[0], counter[1] + 1)
        out.append(allowed)
    return out, counter


def limited(events: DataFrame, key: str, at: str, order: str, limit: int | str, window: float | str, clears: str | None = None) -> DataFrame:
    """events with `allowed`; limit and window are numbers or columns that hold one for each key. The fold of a key needs its events in order; they come sorted and in batches, and only the
    counter is kept, so a key with very many events takes no more memory than one with few."""
    ordered = events.withColumn("_s", F.unix_micros(F.col(at).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, "_s", order)
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(frames):
        held, counter = object(), None
        for frame in frames:
            out = []
            for value, rows in frame.groupby(key, sort=False, dropna=False):
                same = value == held or pd.isna(value) and pd.isna(held)
                most, lasts = (int(rows[x].iloc[0]) if isinstance(x, str) else x for x in (limit, window))
                passed, counter = decide([s / 1e6 for s in rows["_s"]], most, lasts, rows[clears].tolist() if clears else None, counter if same else None)
                held = value
                out += passed
            yield frame.drop(columns="_s").assign(allowed=out)

    return ordered.mapInPandas(run, schema)


def limited_actions(events: DataFrame, action: str, key: str, at: str, order: str, clears: str | None = None) -> DataFrame:
    """events with `allowed` by the limits in force, each action and client by itself; an action without a limit is let through."""
    each = {name: F.create_map(*[F.lit(x) for row in LIMITS for x in (row[0], row[n])]) for n, name in ((1, "_limit"), (2, "_window"))}
    known = {name: F.coalesce(F.try_element_at(table, F.col(action)), F.lit(2**31 - 1 if name == "_limit" else 1)) for name, table in each.items()}
    keyed = events.withColumns({**known, "_client": F.to_json(F.struct(F.col(action).alias("a"), F.col(key).alias("k")))})
    return limited(keyed, "_client", at, order, "_limit", "_window", clears).drop("_limit", "_window", "_client")


def limit_table(spark) -> DataFrame:
    return spark.createDataFrame(list(LIMITS), "action string, allowed int, seconds int")
