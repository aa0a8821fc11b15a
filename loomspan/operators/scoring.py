"""Windows and spans of a text that matter for a goal."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine
from .retrieval import blocks


def goal_windows(docs: DataFrame, doc: str, text: str, goal: str, size: int, overlap: int, most: int) -> DataFrame:
    """doc, start, end, matched, text, omitted: the windows with most distinct words of the goal, in order of their place.

    Windows begin every size - overlap characters; blank ones are left out. Ties go to the earlier one. omitted counts the
    document's other windows.
    """
    terms = F.array(*(F.lit(t) for t in dict.fromkeys(goal.lower().split()))) if goal.split() else F.expr("cast(array() as array<string>)")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    w = docs.where(F.length(text) > 0).select(F.col(doc).alias("doc"), F.col(text).alias("_t"), F.explode(starts).alias("start"))
    w = w.select("doc", "start", F.substring("_t", F.col("start") + 1, F.lit(size)).alias("text")).where(F.col("text").rlike(r"\S"))
    w = w.withColumn("matched", F.size(F.filter(terms, lambda t: F.contains(F.lower("text"), t)))).withColumn("end", F.col("start") + F.length("text"))
    by = W.partitionBy("doc")
    ranked = w.withColumn("_r", F.row_number().over(by.orderBy(F.desc("matched"), "start"))).withColumn("omitted", F.greatest(F.lit(0), F.count("*").over(by) - most))
    return ranked.where(f"_r <= {most}").drop("_r")


def window_cosines(windows: DataFrame, key: str, vector: str, references: DataFrame, reference: str, reference_vector: str) -> DataFrame:
    """key, cosine, reference: the best of a table of references for each window; the first of equal ones. References are met in blocks of a bounded number."""
    own = windows.select(F.col(key).alias("key"), F.col(vector).alias("_v"))
    met = None
    for r in blocks(references.select(F.col(reference).alias("reference"), F.col(reference_vector).alias("_r")), "reference"):
        part = own.join(F.broadcast(r)).select("key", "reference", cosine(F.col("_v"), F.col("_r")).alias("cosine"))
        met = part if met is None else met.union(part)
    best = met.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("o"), "reference", "cosine")).alias("b"))
    return best.select("key", "b.cosine", "b.reference")


def covered(spans: DataFrame, doc: str, start: str, end: str) -> DataFrame:
    """doc, covered: characters that at least one of possibly overlapping spans covers."""
    w = W.partitionBy(doc).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    own = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), before))
    return spans.select(F.col(doc).alias("doc"), own.alias("_c")).groupBy("doc").agg(F.sum("_c").alias("covered"))


class Selection:
    """Windows of one text, apart from each other and in order, that take in spans while window count, length and room allow."""

    def __init__(self, length: int, most: int, room: int, window: int, padding: int):
        self.length, self.most, self.room, self.window, self.padding = length, most, room, window, padding
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.used = 0

    def offer(self, start: int, end: int) -> str | None:
        """Takes the span in; or says which bound it would break: max_chars or max_windows."""
        at = bisect_right(self.starts, start)
        if at and end <= self.ends[at - 1]:
            return None  # it is shown already
        spare = min(self.window, self.room - self.used) - (end - start)
        if spare < 0:
            return "max_chars"
        # Padding is shared out evenly; what the text's beginning can't take goes to the end.
        pad = min(2 * self.padding, spare)
        low = max(0, start - pad // 2)
        high = min(self.length, end + pad - (start - low))
        # The windows that the padded span overlaps or touches are neighbours in the order.
        i, j = bisect_left(self.ends, low), bisect_right(self.starts, high)
        if i < j:
            low, high = min(low, self.starts[i]), max(high, self.ends[j - 1])
        freed = sum(self.ends[i:j]) - sum(self.starts[i:j])
        if high - low > self.window or len(self.starts) - (j - i) + 1 > self.most:
            return "max_windows"
        if self.used - freed + high - low > self.room:
            return "max_chars"
        self.used += high - low - freed
        self.starts[i:j], self.ends[i:j] = [low], [high]
        return None


def union_spans(spans: list[tuple[float, int, int]], length: int, most: int, room: int, padding: int, window: int | None = None) -> tuple[list[tuple[int, int]], list[str]]:
    """Windows from (score, start, end), best first, and the bounds that kept others out. window bounds one window's length (None: the room)."""
    kept = Selection(length, most, room, room if window is None else window, padding)
    told = {kept.offer(a, b) for _, a, b in sorted(spans, key=lambda s: (-s[0], *s[1:]))}
    return list(zip(kept.starts, kept.ends)), sorted(told - {None})


def scored_spans(spans: DataFrame, doc: str, start: str, end: str, score: str, length: str, most: int, room: int, padding: int, window: int | None = None) -> DataFrame:
    """doc, start, end, omitted (bounds that kept spans out): the union of each document's scored spans, whose number the windows bound."""
    kind = spans.schema[doc].dataType.simpleString()
    lists = spans.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(score).cast("double").alias("s"), F.col(start).cast("bigint").alias("a"), F.col(end).cast("bigint").alias("b")))).alias("_s"), F.max(length).cast("bigint").alias("_n"))

    def fold(batches):
        for batch in batches:
            got = [union_spans([(x["s"], x["a"], x["b"]) for x in s], n, most, room, padding, window) for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            spans_ = pa.array([[{"start": a, "end": b} for a, b in w] for w, _ in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans_, pa.array([r for _, r in got], pa.list_(pa.string()))], names=["doc", "_w", "omitted"])

    return lists.mapInArrow(fold, f"doc {kind}, _w array<struct<start:bigint,end:bigint>>, omitted array<string>").select("doc", F.explode("_w").alias("_x"), "omitted").select("doc", "_x.start", "_x.end", "omitted")


def link_scores(links: DataFrame, keyword: Column, cosine_col: Column, weight: float) -> DataFrame:
    """links and score: the weighted mean of the keyword score and the cosine, the latter at least 0."""
    return links.withColumn("score", F.lit(weight) * keyword + F.lit(1.0 - weight) * F.greatest(F.lit(0.0), cosine_col))


def sentences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, quote, start, text: the whole text and the clauses that end after marks of a sentence or a line, with their places."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)[^。！？.!?\n]*(?:[。！？.!?\n]+|$)"), F.lit(0))
    folded = F.aggregate(parts, F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,text:string>>))"), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), p.alias("text")))).alias("out")), lambda s: s["out"])
    trimmed = F.transform(folded, lambda c: F.struct((c["start"] + F.length(c["text"]) - F.length(F.ltrim(c["text"]))).cast("int").alias("start"), F.trim(F.regexp_replace(c["text"], r"\n+$", "")).alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col(text).alias("text")))
    return docs.where(F.length(text) > 0).select(F.col(doc).alias("doc"), F.posexplode(F.concat(whole, F.filter(trimmed, lambda c: c["text"] != ""))).alias("quote", "c")).select("doc", "quote", "c.start", "c.text")
