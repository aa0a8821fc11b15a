"""An ordered log of events: chains, receipts, pairings of requests and answers, and violations of its rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entry_digest(previous: Column, seq: Column, event: Column, payload: Column) -> Column:
    """SHA-256 of an entry: the digest before it and its fields, each after its length in bytes."""
    field = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*(field(F.coalesce(c, F.lit(""))) for c in (previous, seq.cast("string"), event, payload))).cast("binary"), 256)


def hash_chain(log: DataFrame, run: list[str], seq: str, event: str, payload: str) -> DataFrame:
    """log with digest and previous_sha256: the digest of the entry before it in its run, null for the first.

    A digest covers the one before it, so whoever changes an entry has to change all that follow. That makes a run
    sequential: its sorted entries pass through one task, which holds one digest of them at a time.
    """

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            runs = list(zip(*(batch.column(c).to_pylist() for c in run)))
            digests, before = [], []
            for key, *fields in zip(runs, *(batch.column(c).cast(pa.string()).to_pylist() for c in (seq, event, payload))):
                if key != held:
                    held, last = key, None
                parts = [(x or "").encode() for x in (last, *fields)]
                before.append(last)
                last = hashlib.sha256(b"".join(b"%d:%s" % (len(x), x) for x in parts)).hexdigest()
                digests.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(before, pa.string())], names=[*batch.schema.names, "digest", "previous_sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)
    return log.repartition(*run).sortWithinPartitions(*run, seq).mapInArrow(chained, f"{schema}, digest string, previous_sha256 string")


def chain_violations(log: DataFrame, run: list[str], seq: str, event: str, payload: str, first: int = 0) -> DataFrame:
    """run, seq and reason of entries that are not numbered one after the other from first, that were changed, or that don't name the digest before them.

    Each entry is held against what it names, so all entries of a run are checked at once.
    """
    w = W.partitionBy(*run).orderBy(seq)
    own = entry_digest(F.col("previous_sha256"), F.col(seq), F.col(event), F.col(payload))
    out = log.withColumn("_n", F.row_number().over(w) - 1 + first).withColumn("_d", F.lag("digest").over(w))
    reason = F.when(F.col(seq) != F.col("_n"), "sequence").when(F.col("digest") != own, "digest").when(~F.col("previous_sha256").eqNullSafe(F.col("_d")), "previous")
    return out.withColumn("reason", reason).where("reason is not null").select(*run, seq, "reason")


def restored(log: DataFrame, run: list[str], seq: str, complete: Column) -> DataFrame:
    """The entries of each run before its first incomplete one (a torn tail)."""
    torn = F.sum(F.when(complete, 0).otherwise(1)).over(W.partitionBy(*run).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return log.withColumn("_t", torn).where("_t = 0").drop("_t")


def receipt(log: DataFrame, run: list[str], kinds: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Counts and sums of a run's entries in one pass, and page_fetches: fetches without searches, at least 0."""
    out = log.groupBy(*run).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()), *(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()))
    return out.withColumn("page_fetches", F.greatest(F.lit(0), F.col("fetches") - F.col("searches"))) if {"fetches", "searches"} <= kinds.keys() else out


def receipt_differences(log_receipt: DataFrame, claimed: DataFrame, run: list[str]) -> DataFrame:
    """run, field, counted, claimed where a receipt is not what the log adds up to."""
    fields = [c for c in claimed.columns if c not in run and c in log_receipt.columns]
    both = log_receipt.alias("a").join(claimed.alias("b"), run, "full_outer")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("double").alias("counted"), F.col(f"b.{c}").cast("double").alias("claimed")) for c in fields))
    return both.select(*run, F.explode(each).alias("x")).select(*run, "x.*").where(~F.col("counted").eqNullSafe(F.col("claimed")))


def unanswered(intents: DataFrame, answers: DataFrame, run: list[str], seq: str, answers_seq: str) -> DataFrame:
    """Intents that no answer names."""
    named = answers.select(*run, F.col(answers_seq).alias(seq)).distinct()
    return intents.join(named, [*run, seq], "left_anti")


def paired(intents: DataFrame, answers: DataFrame, run: list[str], seq: str, answer_seq: str) -> DataFrame:
    """Each intent and the first later answer within its run and key, by order alone: an answer closes the last open intent."""
    i = intents.select(*run, F.col(seq).alias("_s"), F.lit(0).alias("_k"))
    a = answers.select(*run, F.col(answer_seq).alias("_s"), F.lit(1).alias("_k"))
    w = W.partitionBy(*run).orderBy("_s", "_k")
    nxt = i.union(a).withColumn("_nk", F.lead("_k").over(w)).withColumn("_ns", F.lead("_s").over(w)).where("_k = 0")
    return nxt.select(*run, F.col("_s").alias("intent_seq"), F.when(F.col("_nk") == 1, F.col("_ns")).alias("answer_seq"))


def most_pending(log: DataFrame, run: list[str], seq: str, opens: Column, closes: Column) -> DataFrame:
    """run and pending: how many operations were open at once, at most."""
    w = W.partitionBy(*run).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    n = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w)
    return log.withColumn("_n", n).groupBy(*run).agg(F.max("_n").alias("pending"))


def counter_violations(log: DataFrame, run: list[str], seq: str, counts: Column, stored_counter: str) -> DataFrame:
    """Entries whose stored running counter is not the number of counted entries up to them."""
    n = F.sum(F.when(counts, 1).otherwise(0)).over(W.partitionBy(*run).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return log.withColumn("expected", n).where(F.col("expected") != F.col(stored_counter))


def between(rows: DataFrame, fetches: DataFrame, key: str, seq: str, fetch_seq: str, after: str | None = None) -> DataFrame:
    """rows for which a fetch of the same key stands before them (and after their own earlier mark, if named).

    The last fetch before each row is carried forward in order, so no pairs of rows and fetches are made.
    """
    f = fetches.select(F.col(key).alias("_k"), F.col(fetch_seq).alias("_s"), F.lit(0).alias("_o"), F.lit(None).cast(rows.schema.simpleString()).alias("_r"))
    r = rows.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), F.lit(1).alias("_o"), F.struct(*rows.columns).alias("_r"))
    w = W.partitionBy("_k").orderBy("_s", F.desc("_o")).rowsBetween(W.unboundedPreceding, 0)
    out = f.union(r).withColumn("_f", F.last(F.when(F.col("_o") == 0, F.col("_s")), ignorenulls=True).over(w)).where("_o = 1")
    ok = F.col("_f").isNotNull() if after is None else F.col("_f") > F.col(f"_r.{after}")
    return out.where(ok).select("_r.*")


def contract_violations(log: DataFrame, event: str, rules: DataFrame) -> DataFrame:
    """Entries that lack a column that their kind must have, or have one that it must not; rules: event, column, required.

    rules is a small table of the program's own; its rows become conditions of one pass over the log.
    """
    own = [(r["event"], r["column"], r["required"]) for r in rules.collect()]
    found = F.filter(F.array(*(F.when((F.col(event) == e) & (F.col(c).isNull() if need else F.col(c).isNotNull()), F.lit(f"{'missing' if need else 'unexpected'} {c}")) for e, c, need in own)), lambda x: x.isNotNull())
    return log.withColumn("violations", found).where(F.size("violations") > 0)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with how often and on which side: replay checks compare a log with its recomputation."""
    names = left.columns
    both = left.withColumn("_n", F.lit(1)).union(right.select(*names).withColumn("_n", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0").withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("times", F.abs("_n")).drop("_n")


def population_digest(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """key, items, digest: SHA-256 of a group's items in order, comma-joined. A group is one run's bounded population."""
    return rows.groupBy(*key).agg(F.count(item).alias("items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col(item).cast("string"))), ",").cast("binary"), 256).alias("digest"))


def usage_violations(calls: DataFrame, prompt: str, completion: str, total: str) -> DataFrame:
    return calls.where(F.col(prompt) + F.col(completion) != F.col(total))


def append_batch(existing: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, conflicts): what of a batch is not there yet, and keys that are there with other content. Repeating a batch adds nothing."""
    names = [c for c in batch.columns if c != key]
    once = batch.distinct()
    known = existing.select(F.col(key).alias("_key"), F.struct(*names).alias("_old"))
    met = once.join(known, F.col(key) == F.col("_key"), "left")
    return met.where("_key is null").select(*batch.columns), met.where(F.col("_key").isNotNull() & ~F.struct(*names).eqNullSafe(F.col("_old"))).select(*batch.columns).distinct()
