"""Streaming folds against their batch forms, and sinks that survive a repeated batch."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import state
from loomspan.streaming import folds


@pytest.fixture
def feed(spark, sf, tmp_path):
    """Events in four files, in order."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumns({"bad": F.col("event_type") == "error", "clear": F.col("event_type") == "signup", "page": F.col("event_type") != "click", "at": F.col("event_id").cast("double")})
    folder = str(tmp_path / "events")
    for i in range(4):
        e.where(F.col("event_id").between(250 * i, 250 * i + 249)).coalesce(1).write.mode("append").parquet(folder)
    return folder, e.where("event_id < 1000")


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_breaker_and_latch(spark, feed):
    folder, e = feed
    s = folds.event_stream(spark, folder, e.schema)
    got = run(spark, folds.circuit_breaker(s, "user_id", "event_id", "bad", 2), "breaker")
    want = state.circuit_breaker(e, "user_id", ["event_id"], F.col("bad"), 2).select("user_id", "event_id", "failures", "open")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = run(spark, folds.locator_latch(s, "user_id", "event_id", "bad", "clear", 1), "latch")
    want = state.locator_latch(e, ["user_id"], ["event_id"], F.col("bad"), F.col("clear"), 1).select("user_id", "event_id", "misses", "latched")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_backoff_and_saturation(spark, feed):
    folder, e = feed
    s = folds.event_stream(spark, folder, e.schema)
    got = run(spark, folds.throttle_backoff(s, "user_id", "event_id", "at", "bad", "value"), "backoff")
    want = state.throttle_backoff(e, "user_id", "event_id", "at", F.col("bad"), F.col("value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    got = run(spark, folds.saturation(s, "user_id", "event_id", "page", "bad", 3, 1), "saturation").groupBy("user_id", "window").agg(F.max("fetches").alias("n"), F.max("new").alias("k"))
    want = state.saturation_windows(e, ["user_id"], ["event_id"], F.col("page"), F.col("bad"), 3, 1).select("user_id", "window", "fetches", "new")
    want_rows = {tuple(r) for r in want.collect()}
    assert want_rows == {tuple(r) for r in got.where("n > 0").collect()}


def test_windows_and_idempotent_sink(spark, feed, tmp_path):
    folder, e = feed
    s = folds.event_stream(spark, folder, e.schema)
    out = str(tmp_path / "out")
    write = folds.appended(out, "event_id")
    q = s.select("event_id", "user_id").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = spark.read.parquet(out).count()
    assert n == e.count()
    write(e.select("event_id", "user_id"), 0)  # the same again
    assert spark.read.parquet(out).count() == n
    counts = folds.windowed_counts(s, "ts", "event_type", "1 day", "0 seconds")
    q = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("events")).first()[0] == e.count()
