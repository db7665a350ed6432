"""Feeds of captures and requests as streams. The batch forms take the same columns, so both can be compared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def utc(ts: str = "ts"):
    """Watermarks need a timestamp with a time zone; the session's is UTC."""
    return F.col(ts).cast("timestamp")


def crawl_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Requests of one host with pauses of less than `gap`. Over a stream, a session ends once it is `late` behind."""
    e = events.withColumn("at", utc())
    e = e.withWatermark("at", late) if late and events.isStreaming else e
    grouped = e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests", "total")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests by time window and kind."""
    e = events.withColumn("at", utc())
    e = e.withWatermark("at", late) if events.isStreaming else e
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def new_captures(feed: DataFrame, late: str = "1 day") -> DataFrame:
    """A feed of captures without those seen before, within the watermark."""
    if not feed.isStreaming:
        return feed.dropDuplicates(["capture_key", "timestamp"])
    return feed.withWatermark("at", late).dropDuplicatesWithinWatermark(["capture_key", "timestamp"])


def running_budget(attempts: DataFrame, max_requests: int, max_bytes: int) -> DataFrame:
    """A stream's ledger for each host: what it has spent after each batch, and whether it may go on."""

    def spend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, size = state.get if state.exists else (0, 0)
        for f in frames:
            requests, size = requests + len(f), size + int(f["bytes"].sum())
        state.update((requests, size))
        yield pd.DataFrame({"host": [key[0]], "requests": [requests], "total_bytes": [size], "open": [requests < max_requests and size < max_bytes]})

    return attempts.groupBy("host").applyInPandasWithState(spend, "host long, requests long, total_bytes long, open boolean", "requests long, total_bytes long", "update", GroupStateTimeout.NoTimeout)
