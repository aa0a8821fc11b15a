"""The folds of the event log on a stream: the same results as in batch, with state kept for each entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(events: DataFrame, key: str, order: str, fields: list[str], start: tuple, state: str, step, output: str) -> DataFrame:
    """A fold of each key's events in order of arrival and, inside a batch, of their own order."""
    kind = events.schema[key].dataType.simpleString()
    at = events.schema[order].dataType.simpleString()

    def run(k, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for r in rows[[order, *fields]].itertuples(index=False, name=None):
            now, got = step(now, *r[1:])
            out.append((k[0], r[0], *got))
        held.update(now)
        names = [key, order, *(x.split()[0] for x in output.split(", "))]
        yield pd.DataFrame(out, columns=names)

    return events.select(key, order, *fields).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} {at}, {output}", state, "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(calls: DataFrame, provider: str, order: str, failed: str, limit: int) -> DataFrame:
    """provider, order, failures in a row, open."""

    def step(now, bad):
        n = now[0] + 1 if bad else 0
        return (n,), (n, n >= limit)

    return _stateful(calls, provider, order, [failed], (0,), "n int", step, "failures int, open boolean")


def locator_latch(seen: DataFrame, key: str, order: str, missed: str, reset: str, limit: int) -> DataFrame:
    """key, order, misses in a row, latched until a reset."""

    def step(now, miss, clear):
        n, latched = (0, False) if clear else now
        n = n + 1 if miss and not clear else 0
        latched = latched or n >= limit
        return (n, latched), (n, latched)

    return _stateful(seen, key, order, [missed, reset], (0, False), "n int, latched boolean", step, "misses int, latched boolean")


def throttle_backoff(responses: DataFrame, origin: str, order: str, at: str, throttled: str, wait: str, base: float = 5.0, factor: float = 2.0, most: float = 120.0) -> DataFrame:
    """origin, order, backoff, ready_at."""

    def step(now, t, bad, asked):
        b, ready = now
        if bad:
            b = base if b == 0 else min(most, b * factor)
            ready = max(ready, t + max(b, asked or 0.0))
        elif t >= ready:
            b = 0.0
        return (b, ready), (b, ready)

    return _stateful(responses, origin, order, [at, throttled, wait], (0.0, float("-inf")), "b double, r double", step, "backoff double, ready_at double")


def saturation(log: DataFrame, run: str, order: str, fetch: str, new: str, size: int, least_new: int) -> DataFrame:
    """run, order, window, fetches, new, saturated after each entry of a run; searches (no fetch) change nothing."""

    def step(now, page, fresh):
        window, n, k = now
        if page:
            if n == size:
                window, n, k = window + 1, 0, 0
            n, k = n + 1, k + int(bool(fresh))
        return (window, n, k), (window, n, k, n == size and k < least_new)

    return _stateful(log, run, order, [fetch, new], (0, 0, 0), "w int, n int, k int", step, "window int, fetches int, new int, saturated boolean")


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str, late: str) -> DataFrame:
    """Events of each kind in tumbling windows of event time; what comes later than the watermark is left out."""
    own = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return own.groupBy(F.window("_ts", window), kind).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "events")


def appended(folder: str, key: str):
    """foreachBatch function: adds what of a batch is not in the table yet. A batch that comes again, after a failure, adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        once = batch.dropDuplicates([key])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            once = once.join(spark.read.schema(batch.schema).parquet(folder).select(key), key, "left_anti").select(*batch.columns)
        once.write.mode("append").parquet(folder)

    return write


def event_stream(spark, folder: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
