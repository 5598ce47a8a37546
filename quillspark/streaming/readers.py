"""Streaming twins of the reader-event operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import decide


def limited_stream(events: DataFrame, key: str, at: str, limit: int, window_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(key, event_id, allowed): the limiter whose window begins at a key's first event. State is one counter a key, and
    it ends by event time once its window is over."""
    kind = events.schema[key].dataType.simpleString()

    def run(key_: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["_s", "event_id"])
        allowed, counter = decide((rows["_s"] / 1e6).tolist(), limit, window_seconds, None, counter)
        if counter is not None:
            state.update(counter)
            ends = int((counter[0] + window_seconds) * 1000)
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [key_[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    rows = events.withWatermark(at, delay).select(key, "event_id", at, F.unix_micros(at).alias("_s"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, event_id long, allowed boolean", "began double, n int", "append", GroupStateTimeout.EventTimeTimeout)


def history_stream(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Latest reading and count of each key; for update mode."""
    return events.groupBy(*keys).agg(F.max(at).alias("last_read_at"), F.count("*").alias("read_count"))


def usage_stream(calls: DataFrame, at: str = "ts", model: str = "model", delay: str = "1 hour") -> DataFrame:
    """Calls and tokens of each UTC+4 day and model, closed by the watermark."""
    day = F.window(F.col(at), "1 day", "1 day", "20 hours")  # days begin at 20:00 UTC
    out = calls.withWatermark(at, delay).groupBy(day, F.col(model).alias("model")).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return out.select(F.to_date(F.col("window.start") + F.expr("INTERVAL 4 HOURS")).alias("day"), "model", "calls", "tokens_in", "tokens_out")


def first_seen_stream(pages: DataFrame, url: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each URL once within the delay: exactly-once ingestion, and the memory of rejected scans."""
    return pages.withWatermark(at, delay).dropDuplicatesWithinWatermark([url])


def merge_batches(current: Callable[[], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into a table. The batch number goes to the writer, which a repeated
    batch must overwrite, so that each batch counts once."""

    def run(batch: DataFrame, number: int) -> None:
        write(merge(current(), batch), number)

    return run


def unchanged_only(drafts: DataFrame, works: DataFrame, text: str = "lyrics") -> DataFrame:
    """Drafts whose work still has the text they were made from."""
    now = works.select(F.col("id").alias("_id"), F.sha2(F.col(text), 256).alias("_hash"))
    return drafts.join(now, (drafts["work_id"] == now["_id"]) & (drafts["text_hash"] == now["_hash"]), "left_semi")


def nightly(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """One micro-batch run over what has come since the last one; a name runs once at a time in a session."""
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
