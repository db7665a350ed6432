"""Streams give what their batch forms give."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from relictum.streaming import feeds


def drain(df, name: str, mode: str = "append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_sessions_and_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = f"file://{tmp_path}/events"
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    want = {tuple(r) for r in feeds.windowed_counts(events).collect()}
    assert {tuple(r) for r in drain(feeds.windowed_counts(stream, late="1000 days"), "w", "complete").collect()} == want
    got = {(r.user_id, r.session_start): r.requests for r in drain(feeds.crawl_sessions(stream, late="0 seconds"), "s").collect()}
    all_sessions = {(r.user_id, r.session_start): r.requests for r in feeds.crawl_sessions(events).collect()}
    assert got and all(all_sessions[k] == n for k, n in got.items())


def test_captures_once(spark, tmp_path):
    rows = spark.createDataFrame([("u", "1999", datetime(2024, 1, 1)), ("u", "1999", datetime(2024, 1, 1)), ("u", "2000", datetime(2024, 1, 2))], "capture_key string, timestamp string, at timestamp")
    rows.write.parquet(f"file://{tmp_path}/feed")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/feed")
    assert drain(feeds.new_captures(stream), "c").count() == feeds.new_captures(rows).count() == 2


def test_budgets_of_hosts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "host long, bytes long")
    rows.write.parquet(f"file://{tmp_path}/attempts")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/attempts")
    got = {r.host: (r.requests, r.total_bytes, r.open) for r in drain(feeds.running_budget(stream, 2, 100), "b", "update").orderBy("requests").collect()}
    assert got == {1: (2, 30, False), 2: (1, 5, True)}
    assert rows.where(F.col("host") == 1).count() == 2
