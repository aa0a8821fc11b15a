"""Folds over an ordered log: saturation, circuit breakers, stagnation, drift latches, back-off, versions and queues.

Where a counter only depends on where it was reset, windows count runs; where a step depends on the state before, sorted rows
are folded in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folding import folded


def run_length(rows: DataFrame, key: list[str], order: list[str], hit: Column) -> DataFrame:
    """rows and run: how many rows up to this one, without a break, have hit; 0 where it has not."""
    w = W.partitionBy(*key).orderBy(*order)
    breaks = F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("_hit", hit).withColumn("_island", breaks)
    at = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(W.partitionBy(*key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("run", at.cast("int")).drop("_hit", "_island")


def saturation_windows(log: DataFrame, key: list[str], order: list[str], is_fetch: Column, is_new: Column, size: int, least_new: int) -> DataFrame:
    """key, window, fetches, new, saturated: tumbling windows of so many page fetches; searches don't count. stopped_at is the first saturated window."""
    w = W.partitionBy(*key).orderBy(*order)
    pages = log.where(is_fetch).withColumn("_new", F.when(is_new, 1).otherwise(0)).withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    by = pages.groupBy(*key, "window").agg(F.count("*").alias("fetches"), F.sum("_new").alias("new"))
    by = by.withColumn("saturated", (F.col("fetches") >= size) & (F.col("new") < least_new))
    return by.withColumn("stopped_at", F.min(F.when(F.col("saturated"), F.col("window"))).over(W.partitionBy(*key)))


def quiet_rounds(rounds: DataFrame, key: list[str], order: str, new: str, most: int = 2) -> DataFrame:
    """rounds and quiet (rounds in a row without anything new), saturated once it reaches most."""
    out = run_length(rounds, key, [order], F.col(new) == 0).withColumnRenamed("run", "quiet")
    return out.withColumn("saturated", F.col("quiet") >= most)


def circuit_breaker(calls: DataFrame, provider: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """calls and failures in a row, and whether the breaker is open after the call."""
    return run_length(calls, [provider], order, failed).withColumnRenamed("run", "failures").withColumn("open", F.col("failures") >= limit)


def stagnation(rounds: DataFrame, key: list[str], order: str, progress: Column, window: int, most_changes: int, providers: int) -> DataFrame:
    """key, order, stagnant, changes, offset after each round.

    Progress sets the counter to 0. When it reaches the window, the strategy changes (so often at most) and the counter starts
    again. offset is the provider to begin with.
    """

    def step(state, progressed):
        n, changes = 0 if progressed else state[0] + 1, state[1]
        if n >= window and changes < most_changes:
            n, changes = 0, changes + 1
        return (n, changes), (n, changes, changes % providers)

    rows = rounds.select(*key, order, F.coalesce(progress, F.lit(False)).alias("_p"))
    return folded(rows, key, [order], ["_p"], "stagnant int, changes int, offset int", (0, 0), step).drop("_p")


def locator_latch(seen: DataFrame, key: list[str], order: list[str], missed: Column, reset: Column, limit: int) -> DataFrame:
    """seen and misses in a row, and latched: from the row on where they reach the limit until a reset."""
    own = seen.withColumn("_epoch", F.sum(F.when(reset, 1).otherwise(0)).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    out = run_length(own, [*key, "_epoch"], order, missed & ~reset).withColumnRenamed("run", "misses")
    hit = F.max(F.when(F.col("misses") >= limit, 1).otherwise(0)).over(W.partitionBy(*key, "_epoch").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("latched", hit == 1).drop("_epoch")


def throttle_backoff(responses: DataFrame, origin: str, order: str, at: str, throttled: Column, wait: Column, base: float = 5.0, factor: float = 2.0, most: float = 120.0) -> DataFrame:
    """origin, order, backoff, ready_at after each response: a throttled one waits base, then factor times more, up to most; never less
    than the server asks for. A success after the wait is over sets the back-off to 0."""

    def step(state, at, hit, asked):
        wait, ready = state
        if hit:
            wait = base if wait == 0 else min(most, wait * factor)
            ready = max(ready, at + max(wait, asked))
        elif at >= ready:
            wait = 0.0
        return (wait, ready), (wait, ready)

    rows = responses.select(origin, order, F.col(at).cast("double").alias("_at"), F.coalesce(throttled, F.lit(False)).alias("_t"), F.coalesce(wait.cast("double"), F.lit(0.0)).alias("_w"))
    return folded(rows, [origin], [order], ["_at", "_t", "_w"], "backoff double, ready_at double", (0.0, float("-inf")), step).drop("_at", "_t", "_w")


def polite_schedule(requests: DataFrame, origin: str, order: str, at: str, spacing: Column) -> DataFrame:
    """origin, order, starts_at: each request no sooner than asked, and by its spacing after the one before it at the same origin.

    The start is the largest, over all requests so far, of when one was asked and the spacings since: two windows, no fold.
    """
    w = W.partitionBy(origin).orderBy(order)
    rows = requests.select(origin, order, F.col(at).cast("double").alias("_at"), spacing.cast("double").alias("_s"))
    rows = rows.withColumn("_b", F.coalesce(F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    start = F.col("_b") + F.max(F.col("_at") - F.col("_b")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("starts_at", start).drop("_at", "_s", "_b")


def latest_version_asof(checks: DataFrame, versions: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """checks and the columns of the latest version of the key at or before the check, null if there is none.

    Both tables are put in one order by key and time, versions first, and the last version is carried forward: one shuffle, no
    pairs of checks and versions.
    """
    v = versions.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(at).alias("version_at"), *payload).alias("_v"), F.lit(None).cast(checks.schema.simpleString()).alias("_c"))
    c = checks.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.struct(*checks.columns).alias("_c"))
    w = W.partitionBy("_k").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    return v.union(c).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1").select("_c.*", "_last.*")


def usable_versions(latest: DataFrame, at: str, most_seconds: int, tombstone: str) -> DataFrame:
    """Rows whose version is no tombstone and no older than allowed."""
    return latest.where(~F.coalesce(F.col(tombstone), F.lit(True)) & ((F.col(at).cast("double") - F.col("version_at").cast("double")) <= most_seconds))


def state_transitions(rows: DataFrame, key: str, order: str, state: str, allowed: dict[str, tuple[str, ...]], first: str) -> DataFrame:
    """Rows that don't follow from the state before (or from nothing) by the allowed steps."""
    prev = F.lag(state).over(W.partitionBy(key).orderBy(order))
    ok = F.when(prev.isNull(), F.col(state) == first)
    for a, steps in allowed.items():
        ok = ok.when(prev == a, F.col(state).isin(*steps) if steps else F.lit(False))
    return rows.withColumn("previous", prev).withColumn("_ok", ok.otherwise(F.lit(False))).where("not _ok").drop("_ok")


def outbox_summary(items: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """One row: acknowledged, exhausted, leased, due and waiting items."""
    done, spent = F.col("state") == "acknowledged", F.col("attempts") >= most_attempts
    held = F.col("lease_until") > now
    due = F.coalesce(F.col("next_attempt") <= now, F.lit(True))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    free = ~done & ~spent & ~F.coalesce(held, F.lit(False))
    return items.agg(n(done).alias("acknowledged"), n(~done & spent).alias("exhausted"), n(~done & ~spent & held).alias("leased"), n(free & due).alias("due"), n(free & ~due).alias("waiting"))


def outbox_claim(items: DataFrame, order: str, now: Column, most_attempts: int, n: int = 1) -> DataFrame:
    """The oldest items that may be sent now: not acknowledged, attempts left, due, and no lease that still holds."""
    ok = (F.col("state") != "acknowledged") & (F.col("attempts") < most_attempts) & F.coalesce(F.col("next_attempt") <= now, F.lit(True)) & ~F.coalesce(F.col("lease_until") > now, F.lit(False))
    return items.where(ok).orderBy(order).limit(n)


def frontier(entries: DataFrame, key: str, priority: str, discarded: DataFrame | None = None) -> DataFrame:
    """One entry for each key, of the lowest priority value (then all columns in order); discarded keys don't come back."""
    best = entries.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(priority).alias("_p"), F.struct(*entries.columns).alias("_e"))).alias("m")).select("m._e.*")
    return best.join(discarded.select(key).distinct(), key, "left_anti") if discarded is not None else best


def frontier_order(entries: DataFrame, priority: str, url: str, depth: str, visited: DataFrame | None = None, quantum: int | None = None) -> DataFrame:
    """Unvisited entries by priority, url and depth; the first quantum of them."""
    out = entries.join(visited.select(url).distinct(), url, "left_anti") if visited is not None else entries
    out = out.orderBy(priority, url, depth)
    return out.limit(quantum) if quantum is not None else out
