"""Smaller operators on the records of a run: discovery, corpus growth, context for readers, reports and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_digest
from .folding import folded


def first_provider(answers: DataFrame, query: str, provider_order: str, hits: Column) -> DataFrame:
    """For each query the answer of the first provider, in order, that had hits."""
    best = answers.where(hits > 0).groupBy(F.col(query).alias("_q")).agg(F.min_by(F.struct(*answers.columns), provider_order).alias("a"))
    return best.select("a.*")


def conditional_headers(requests: DataFrame, versions: DataFrame, url: str) -> DataFrame:
    """requests and headers: the earlier version's entity tag, else its date, asked for as a condition; none without a version."""
    v = versions.select(F.col(url).alias("_u"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("value"))
    none = F.expr("cast(array() as array<struct<name:string,value:string>>)")
    return requests.join(v, requests[url] == v["_u"], "left").withColumn("headers", F.when(F.col("_e").isNotNull(), F.array(pair("If-None-Match", "_e"))).when(F.col("_m").isNotNull(), F.array(pair("If-Modified-Since", "_m"))).otherwise(none)).drop("_u", "_e", "_m")


def followed_leads(leads: DataFrame, page_links: DataFrame, queued: DataFrame, page: str, target: str) -> DataFrame:
    """Leads of kind link that stand on their page and are not queued yet, once each."""
    out = leads.where("kind = 'link'").join(page_links.select(page, target).distinct(), [page, target], "left_semi")
    return out.join(queued.select(target).distinct(), target, "left_anti").dropDuplicates([page, target])


def corpus_append(corpus: DataFrame, documents: DataFrame, key: list[str], accepted: Column, generation: int) -> DataFrame:
    """Rows to append: accepted documents that the corpus lacks, under the next generation; the same generation stays if there are none."""
    new = documents.where(accepted).dropDuplicates(key).join(corpus.select(*key).distinct(), key, "left_anti")
    return new.withColumn("generation", F.lit(generation + 1))


def new_queries(queries: DataFrame, succeeded: DataFrame, text: str, seq: str, most: int, most_chars: int) -> DataFrame:
    """Queries whose text did not succeed before, once each, as long as count and characters last."""
    fresh = queries.join(succeeded.select(text).distinct(), text, "left_anti")
    once = fresh.withColumn("_n", F.row_number().over(W.partitionBy(text).orderBy(seq))).where("_n = 1").orderBy(seq).limit(most)
    chars = F.sum(F.length(text)).over(W.orderBy(seq).rowsBetween(W.unboundedPreceding, 0))  # most rows at the most
    return once.withColumn("_c", chars).where(F.col("_c") <= most_chars).drop("_n", "_c")


def page_offsets(pages: DataFrame, document: str, page: str, text: str, gap: int = 2) -> DataFrame:
    """pages with start and end in the document's joined text, two characters apart."""
    w = W.partitionBy(document).orderBy(page)
    end = F.sum(F.length(text) + gap).over(w.rowsBetween(W.unboundedPreceding, 0)) - gap
    return pages.withColumn("end", end).withColumn("start", F.col("end") - F.length(text))


def cited_pages(spans: DataFrame, pages: DataFrame, document: str) -> DataFrame:
    """spans and pages: the numbers of the document's pages that each span touches. A document's pages are one array."""
    p = pages.groupBy(F.col(document).alias("_d")).agg(F.sort_array(F.collect_list(F.struct("page", F.col("start").alias("s"), F.col("end").alias("e")))).alias("_p"))
    out = spans.join(p, spans[document] == p["_d"], "left")
    return out.withColumn("pages", F.transform(F.filter("_p", lambda x: (x["s"] < F.col("end")) & (F.col("start") < x["e"])), lambda x: x["page"])).drop("_d", "_p")


def contiguous_windows(docs: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    """doc, window, start, end, digest: a text cut into windows one after the other."""
    w = docs.where(F.length(text) > 0).select(F.col(doc).alias("doc"), F.col(text).alias("_t"), F.posexplode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).alias("window", "start"))
    part = F.substring("_t", F.col("start") + 1, F.lit(size))
    return w.select("doc", "window", "start", (F.col("start") + F.length(part)).alias("end"), F.sha2(part.cast("binary"), 256).alias("digest"))


def evidence_context(candidates: DataFrame, intent: str, document: str, start: str, end: str, score: str, required: str, most_documents: int, per_document: int, most_chars: int) -> DataFrame:
    """candidates and status: what a reader of one intent is shown: required ones first, then by score, document and place.

    document_limit, window_limit, overlap or character_limit says why one is not shown. The fold runs over one intent's
    shortlist.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([required, score, document, start], ascending=[False, False, True, True], kind="stable")
        shown: dict = {}
        chars, status = 0, []
        for d, a, b in zip(pdf[document], pdf[start], pdf[end]):
            own = shown.get(d, [])
            if d not in shown and len(shown) >= most_documents:
                why = "document_limit"
            elif len(own) >= per_document:
                why = "window_limit"
            elif any(x < b and a < y for x, y in own):
                why = "overlap"
            elif chars + b - a > most_chars:
                why = "character_limit"
            else:
                why = "shown"
                shown.setdefault(d, []).append((a, b))
                chars += b - a
            status.append(why)
        return pdf.assign(status=status)

    return candidates.groupBy(intent).applyInPandas(fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", status string")


def greedy_fill(items: DataFrame, group: str, order: list[str], size: str, room: int) -> DataFrame:
    """items and kept: in order, each item is kept if it still fits beside those kept before it; smaller later ones may fit."""

    def step(used, n):
        fits = used + n <= room
        return used + n if fits else used, (fits,)

    return folded(items.withColumn("_n", F.coalesce(F.col(size).cast("bigint"), F.lit(0))), [group], order, ["_n"], "kept boolean", 0, step).drop("_n")


def state_report(rows: DataFrame, group: str, state: str, states: list[str]) -> DataFrame:
    """Counts of each state as columns, zero where there is none."""
    return rows.groupBy(group).pivot(state, states).count().fillna(0, states)


def acceptance(documents: DataFrame, doc: str, text: str, required: list[str], ordered: list[str], pages: str, page_count: int | None = None) -> DataFrame:
    """doc, required_ok, ordered_ok, pages_ok: all texts present; the ordered ones one after the other; as many pages as expected."""
    have = F.lit(True)
    for t in required:
        have = have & F.contains(F.col(text), F.lit(t))
    at, ok = F.lit(1), F.lit(True)
    for t in ordered:
        found = F.position(F.lit(t), F.col(text), at)
        ok, at = ok & (found > 0), found + len(t)
    return documents.select(doc, F.coalesce(have, F.lit(False)).alias("required_ok"), F.coalesce(ok, F.lit(False)).alias("ordered_ok"), (F.lit(True) if page_count is None else F.col(pages) == page_count).alias("pages_ok"))


def document_identity(url: Column, content_sha: Column, text_sha: Column, revision: Column, *more: Column) -> Column:
    """Identity of a document's node: each part after its length, optional parts in their fixed order, missing ones empty."""
    named = [F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in (url, content_sha, text_sha, revision, *more)]
    return F.concat_ws("|", *named)


def encoding_checks(passages: DataFrame, documents: DataFrame, calls: DataFrame) -> DataFrame:
    """passage_id and reason: passages without their document, without their encoding call, or whose text is not what was encoded."""
    d = documents.select(F.col("document_id").alias("_d")).distinct()
    c = calls.select(F.col("encoding_id").alias("_e"), F.col("batch_index").alias("_b"), "input_sha256")
    met = passages.join(d, F.col("document_id") == F.col("_d"), "left").join(c, (F.col("encoding_id") == F.col("_e")) & (F.col("batch_index") == F.col("_b")), "left")
    reason = F.when(F.col("_d").isNull(), "document").when(F.col("_e").isNull(), "encoding").when(F.sha2(F.col("text").cast("binary"), 256) != F.col("input_sha256"), "input")
    return met.withColumn("reason", reason).where("reason is not null").select("passage_id", "reason")


def coverage_findings(findings: DataFrame, known: DataFrame, document: str) -> DataFrame:
    """findings and reason: repeated, already_covered (by a known span) or outside_text, if one holds."""
    k = known.select(F.col(document).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    n = F.row_number().over(W.partitionBy(document, "start", "end").orderBy("finding_id"))
    inside = findings.join(k, (findings[document] == k["_d"]) & (k["_s"] <= findings["start"]) & (findings["end"] <= k["_e"]), "left_semi").select("finding_id").distinct().withColumn("_in", F.lit(True))
    reason = F.when((F.col("start") < 0) | (F.col("end") > F.col("chars")) | (F.col("start") >= F.col("end")), "outside_text").when(F.col("_n") > 1, "repeated").when(F.col("_in"), "already_covered")
    return findings.withColumn("_n", n).join(inside, "finding_id", "left").withColumn("reason", reason).drop("_n", "_in")


def attempt_violations(attempts: DataFrame, document: str, order: str) -> DataFrame:
    """document and reason: an extraction has at most one generic retry, after a profile's failure, and nothing after a success."""
    w = W.partitionBy(document).orderBy(order)
    out = attempts.withColumn("_g", F.sum(F.when(F.col("generic"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_p", F.lag("succeeded").over(w))
    reason = F.when(F.col("_p"), "after_success").when(F.col("_g") > 1, "second_retry").when(F.col("generic") & F.col("_p").isNull(), "first_generic")
    return out.withColumn("reason", reason).where("reason is not null").select(document, "reason")


def outbox_finish(items: DataFrame, results: DataFrame, key: str, now: Column, delay: int) -> DataFrame:
    """items after their results: acknowledged, or one attempt more and due after a delay; leases end."""
    r = results.select(F.col(key).alias("_k"), "delivered")
    out = items.join(r, items[key] == r["_k"], "left")
    hit = F.col("delivered").isNotNull()
    return out.select(
        *(c for c in items.columns if c not in ("state", "attempts", "next_attempt", "lease_until")), F.when(F.col("delivered"), "acknowledged").otherwise(F.col("state")).alias("state"), (F.col("attempts") + F.when(hit, 1).otherwise(0)).alias("attempts"),
        F.when(hit & ~F.col("delivered"), now + delay).otherwise(F.col("next_attempt")).alias("next_attempt"), F.when(hit, F.lit(None)).otherwise(F.col("lease_until")).alias("lease_until"),
    )


def plan_bindings(log: DataFrame, reason: str, pattern: str) -> DataFrame:
    """Names that reasons of a log give, once each: what a fitted plan was cut from."""
    return log.select(F.explode(F.regexp_extract_all(reason, F.lit(pattern), F.lit(1))).alias("binding")).distinct()


def unjudged(readings: DataFrame, refusal: str) -> DataFrame:
    """Readings that no judge answered for are kept, as unjudged, with the refusal as their reason."""
    lost = F.col(refusal).isNotNull()
    return readings.withColumn("grade", F.when(lost, "unjudged").otherwise(F.col("grade"))).withColumn("action", F.when(lost, "keep").otherwise(F.col("action"))).withColumn("reason", F.when(lost, F.col(refusal)).otherwise(F.col("reason")))


def request_digest(model: Column, prefix: str, texts: Column) -> Column:
    """Digest of an encoding request: model and prefixed texts in order."""
    return json_digest(F.struct(model.alias("model"), F.transform(texts, lambda t: F.concat(F.lit(prefix), t)).alias("texts")))


def packet(windows: Column, metadata: Column) -> Column:
    """What a judge is sent: the windows' texts first, one blank line between them, then the metadata as JSON."""
    return F.concat_ws("\n\n", F.array_join(F.transform(windows, lambda w: w["text"]), "\n\n"), F.to_json(metadata))


def document_titles(blocks: DataFrame, doc: str, ordinal: str) -> DataFrame:
    """doc and title: the first title or heading, else the first text that is not blank."""
    b = blocks.where(F.trim("text") != "").withColumn("_r", F.when(F.col("label").isin("title", "section_header"), 0).otherwise(1))
    return b.groupBy(doc).agg(F.min_by("text", F.struct("_r", ordinal)).alias("title"))


def resolved_quotes(chosen: DataFrame, quotes: DataFrame) -> DataFrame:
    """chosen (doc, quote) with start, end and text; unknown ids keep nulls."""
    return chosen.join(quotes.select("doc", "quote", "start", (F.col("start") + F.length("text")).alias("end"), "text"), ["doc", "quote"], "left")
