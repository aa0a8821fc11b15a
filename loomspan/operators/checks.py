"""Rules on the records of a run: validators that return the rows that break a rule, and small decisions and projections.

A validator gives the key of each offending row and the first rule that it breaks; a table without offences gives none.
All are joins, windows within one key, and aggregates, so they hold for any number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine, json_digest
from .filters import worst_verdict
from .retrieval import bm25, fuse, vector_topk

#: Refusals that end a run; all others refuse one page.
CONTRACT_REFUSALS = ("adapter_contract", "ledger_sink_failed", "graph_contract", "graph_sink_failed", "research_contract")


def _broken(rows: DataFrame, keys: list[str], *rules: tuple[str, Column]) -> DataFrame:
    """keys and reason of the rows for which a rule's condition holds, the first one named. A null condition doesn't hold."""
    reason = None
    for name, condition in rules:
        reason = F.when(condition, name) if reason is None else reason.when(condition, name)
    return rows.withColumn("reason", reason).where("reason is not null").select(*keys, "reason")


# Admission and policy


def host_expansion(rows: DataFrame, host: str, seq: str, configured: DataFrame, denied: DataFrame, most: int) -> DataFrame:
    """rows and decision: configured, denied, expanded (one of the first most other hosts, in order of arrival) or host_limit."""
    c, d = configured.select(F.col("host").alias("_c")).distinct(), denied.select(F.col("host").alias("_d")).distinct()
    met = rows.join(c, rows[host] == c["_c"], "left").join(d, F.col(host) == F.col("_d"), "left")
    first = met.where("_c is null and _d is null").groupBy(F.col(host).alias("_h")).agg(F.min(seq).alias("_s")).orderBy("_s", "_h").limit(most).select("_h")
    out = met.join(F.broadcast(first), F.col(host) == F.col("_h"), "left")
    return out.withColumn("decision", F.when(F.col("_d").isNotNull(), "denied").when(F.col("_c").isNotNull(), "configured").when(F.col("_h").isNotNull(), "expanded").otherwise("host_limit")).drop("_c", "_d", "_h")


def kept_readings(readings: DataFrame, keep: Column) -> DataFrame:
    """readings (decision, action, reason): pages that a client keeps although the judge rejected them say so."""
    hit = F.coalesce(keep & (F.col("decision") == "reject"), F.lit(False))
    return readings.withColumn("reason", F.when(hit, F.concat(F.lit("kept_by_client:"), "reason")).otherwise(F.col("reason"))).withColumn("action", F.when(hit, "keep").otherwise(F.col("action")))


def ends_run(refusal: Column) -> Column:
    return F.coalesce(refusal.isin(*CONTRACT_REFUSALS), F.lit(False))


def tracking_violations(names: DataFrame, name: str) -> DataFrame:
    """name and reason: names of tracked parameters are lower case, not blank, without marks of a query, and given once."""
    n = names.groupBy(name).agg(F.count("*").alias("_n"))
    c = F.col(name)
    return _broken(n, [name], ("blank", F.coalesce(F.trim(c) == "", F.lit(True))), ("mark", c.rlike(r"[&=?#\s]")), ("case", c != F.lower(c)), ("repeated", F.col("_n") > 1))


def plan_violations(items: DataFrame, plan: str, item: str, text: str, refs: str, known: DataFrame, most: int, most_chars: int) -> DataFrame:
    """plan and reason: ids are used once, not too many, texts neither blank nor too long, and references known."""
    used = items.select(plan, item, F.explode_outer(refs).alias("_ref")).join(known.select(F.col("ref").alias("_ref")).distinct().withColumn("_k", F.lit(True)), "_ref", "left")
    lost = used.groupBy(plan).agg(F.bool_or(F.col("_ref").isNotNull() & F.col("_k").isNull()).alias("_lost"))
    c = items.groupBy(plan).agg(F.count("*").alias("_n"), F.count_distinct(item).alias("_u"), F.bool_or(F.coalesce(F.trim(text) == "", F.lit(True))).alias("_blank"), F.max(F.length(text)).alias("_long")).join(lost, plan)
    return _broken(c, [plan], ("repeated_id", F.col("_u") < F.col("_n")), ("limit", F.col("_n") > most), ("blank", F.col("_blank")), ("length", F.col("_long") > most_chars), ("reference", F.col("_lost")))


def discovery_trace(hits: DataFrame, query: str, url: str, host: str, seq: str, most_hosts: int) -> tuple[DataFrame, DataFrame]:
    """(urls, trace): each accepted url once, at its first hit, from the first most_hosts hosts; and which queries found it."""
    hosts = hits.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_h")).agg(F.min(seq).alias("_s")).orderBy("_s", "_h").limit(most_hosts)
    ok = hits.join(F.broadcast(hosts.select("_h")), F.col(host) == F.col("_h"), "left_semi")
    urls = ok.groupBy(url).agg(F.min(seq).alias("first_seq"), F.min_by(query, seq).alias("first_query"))
    return urls, ok.select(url, query).distinct()


def grade_stop(log: DataFrame, run: str, seq: str, is_fetch: Column, satisfied: Column, confidence: Column, every: int, least: float) -> DataFrame:
    """run and stop_seq: the first fetch, counted in steps of every, at which the grade is satisfied and sure enough."""
    n = F.sum(F.when(is_fetch, 1).otherwise(0)).over(W.partitionBy(run).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    due = log.withColumn("_n", n).where(is_fetch & (F.col("_n") % every == 0) & satisfied & (confidence >= least))
    return due.groupBy(run).agg(F.min(seq).alias("stop_seq"))


def result_violations(results: DataFrame, claims: DataFrame, result: str, least: float) -> DataFrame:
    """result (status, stop_reason, unresolved, intent_covered, confidence, claims) and reason: an answered result is complete, reviewed
    and sure; any other shows no answer. claims: result, claim, verdict, cited (matches kept evidence)."""
    c = claims.groupBy(F.col(result).alias("_r")).agg(F.count_distinct("claim").alias("_k"), F.count("*").alias("_n"), F.bool_and(F.col("verdict") == "supported").alias("_ok"), F.bool_and("cited").alias("_cited"))
    met = results.join(c, F.col(result) == F.col("_r"), "left")
    answered = F.col("status") == "answered"
    n = F.coalesce("_n", F.lit(0))
    return _broken(
        met, [result], ("partial_with_answer", ~answered & (F.col("claims") > 0)), ("stop", answered & (F.col("stop_reason") != "answered")), ("unresolved", answered & (F.col("unresolved") > 0)), ("intent", answered & ~F.col("intent_covered")),
        ("coverage", answered & ((n != F.col("claims")) | (F.col("_k") != F.col("claims")))), ("unsupported", answered & ~F.col("_ok")), ("citation", answered & ~F.col("_cited")), ("confidence", answered & (F.col("confidence") < least)),
    )


# Retrieval


def search(passages: DataFrame, queries: DataFrame, candidates: int, least: float, top: int, languages: list[str] | None = None) -> DataFrame:
    """query, passage, cosine, fused, rank: the whole search of a corpus in one plan.

    passages: passage, text, lang, vector; queries: query, text, vector. The best candidates by vectors and by BM25 are
    fused by their ranks, every candidate gets its exact cosine, and those that are close enough and of an asked
    language are cut to the top. No order is open: ties go to the smaller passage.
    """
    v = vector_topk(passages, "passage", "vector", queries, "query", "vector", candidates).select("query", F.col("key").alias("passage"), "rank")
    t = bm25(passages, "passage", "text", queries, "query", "text", candidates)
    both = fuse(v, t, ["query", "passage"]).select("query", "passage", "fused", F.col("rank").alias("_r"))
    met = both.join(passages.select("passage", "lang", F.col("vector").alias("_v")), "passage").join(queries.select("query", F.col("vector").alias("_q")), "query")
    ok = met.withColumn("cosine", cosine(F.col("_v"), F.col("_q"))).where(F.col("cosine") >= least)
    ok = ok.where(F.col("lang").isin(*languages)) if languages is not None else ok
    return ok.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("_r"))).where(f"rank <= {top}").select("query", "passage", "cosine", "fused", "rank")


def query_evidence_violations(hits: DataFrame, query: str, rank: str, vector_rank: str, lexical_rank: str, fused: str, constant: int = 60) -> DataFrame:
    """query, rank and reason: ranks run from 1 without a gap, the fused value follows from both ranks and never grows, and every hit is in a list."""
    w = W.partitionBy(query).orderBy(rank)
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    out = hits.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(fused).over(w))
    return _broken(out, [query, rank], ("rank", F.col(rank) != F.col("_n")), ("unlisted", F.col(vector_rank).isNull() & F.col(lexical_rank).isNull()), ("fused", F.abs(F.col(fused) - part(vector_rank) - part(lexical_rank)) > 1e-12), ("order", F.col(fused) > F.col("_p")))


def corpus_counts(passages: DataFrame, documents: DataFrame, most_passages: int, most_documents: int) -> DataFrame:
    """One row: documents, passages, characters, and whether either is over its capacity."""
    p = passages.agg(F.count("*").alias("passages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    d = documents.agg(F.count("*").alias("documents"))
    return d.join(F.broadcast(p)).withColumn("over_capacity", (F.col("passages") > most_passages) | (F.col("documents") > most_documents))  # one row each


def evidence_size(selection: DataFrame, group: str, document: str, text: str) -> DataFrame:
    """group, documents, characters of a selection; a text that is chosen twice counts once."""
    return selection.select(group, document, text).distinct().groupBy(group).agg(F.count_distinct(document).alias("documents"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))


def append_receipt_violations(receipts: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """key and reason: no more was added than there is, and what was encoded adds up to the added passages."""
    n = calls.groupBy(F.col(key).alias("_k")).agg(F.sum("inputs").alias("_i"))
    met = receipts.join(n, F.col(key) == F.col("_k"), "left")
    return _broken(met, [key], ("documents", F.col("added_documents") > F.col("total_documents")), ("passages", F.col("added_passages") > F.col("total_passages")), ("encoded", F.coalesce("_i", F.lit(0)) != F.col("added_passages")))


def lead_record_violations(leads: DataFrame, passages: DataFrame, key: str, most: int) -> DataFrame:
    """key and reason: a record's sources and its selected passages' sources are the same, each source once, and not too many."""
    a = leads.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("_s"), F.count("*").alias("_n"))
    b = passages.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("_p"))
    met = a.join(b, key, "full_outer")
    return _broken(met, [key], ("limit", F.col("_n") > most), ("repeated", F.col("_n") > F.size("_s")), ("sources", ~F.col("_s").eqNullSafe(F.col("_p"))))


# Windows and similarity


def exact_windows(spans: DataFrame, docs: DataFrame, doc: str, text: str, anchors: DataFrame) -> DataFrame:
    """spans (doc, start, end) with their exact text and its digest, and how many anchors (doc, start, end) lie inside."""
    own = spans.join(docs.select(doc, F.col(text).alias("_t")), doc).withColumn("text", F.expr("substring(_t, cast(start + 1 as int), cast(end - start as int))")).drop("_t")
    a = anchors.select(F.col(doc).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = spans.join(a, (F.col(doc) == F.col("_d")) & (F.col("_s") >= F.col("start")) & (F.col("_e") <= F.col("end"))).groupBy(doc, "start", "end").agg(F.count("*").alias("anchors"))
    return own.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(inside, [doc, "start", "end"], "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))


def similarity_violations(windows: DataFrame, documents: DataFrame, doc: str, references: int) -> DataFrame:
    """doc and reason: cosines lie within -1 and 1, references exist, and a document's cosine is its windows' largest."""
    w = windows.groupBy(F.col(doc).alias("_d")).agg(F.max("cosine").alias("_m"), F.bool_or(F.isnan("cosine") | (F.abs("cosine") > 1)).alias("_bad"), F.bool_or((F.col("reference") < 0) | (F.col("reference") >= references)).alias("_ref"))
    met = documents.join(w, F.col(doc) == F.col("_d"), "left")
    return _broken(met, [doc], ("no_window", F.col("_d").isNull()), ("range", F.col("_bad")), ("reference", F.col("_ref")), ("maximum", F.col("cosine") != F.col("_m")))


def joined_reading(parts: DataFrame, doc: str, kind: str, order: str, text: str, gap: str = "\n\n") -> DataFrame:
    """parts with start and end in the reading that joins them, recognised spans before claims, each in order."""
    w = W.partitionBy(doc).orderBy(kind, order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length(text) + len(gap)).over(w) - len(gap)
    return parts.withColumn("end", end).withColumn("start", F.col("end") - F.length(text))


def extraction_violations(records: DataFrame, key: str, least_chars: int) -> DataFrame:
    """key and reason: a record's tier follows from its text, its digest from its text, and what was cut from the policy's bound."""
    t = F.length("text")
    return _broken(records, [key], ("digest", F.sha2(F.col("text").cast("binary"), 256) != F.col("text_sha256")), ("tier", (F.col("tier") == "fast") & (t < least_chars)), ("omitted", (F.col("omitted_chars") < 0) | (F.col("omitted_chars") + t != F.col("whole_chars"))))


# Graph, identity and reviews


def citation_id(value: Column) -> Column:
    return F.concat(F.lit("cite:"), json_digest(value))


def trace_edges(hits: DataFrame, relation: str, source: str, target: str) -> DataFrame:
    """id, relation, source, target of each distinct step of a search: which query discovered or retrieved what."""
    e = hits.select(F.lit(relation).alias("relation"), F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    return e.withColumn("id", F.concat(F.lit("edge:"), json_digest(F.struct("relation", "source", "target"))))


def visual_nodes(readings: DataFrame, doc: str, spans: str) -> DataFrame:
    """doc, node_id, start, end of each span of a visual reading that is not empty; a node is known by document and place."""
    s = readings.select(doc, F.explode(spans).alias("_s")).select(doc, F.col("_s.start").alias("start"), F.col("_s.end").alias("end")).where("end > start").distinct()
    return s.withColumn("node_id", F.concat_ws(":", doc, "start", "end"))


def bundle_order(bundles: DataFrame, group: str) -> DataFrame:
    """bundles (nodes, newest, relations, ids) and rank: few nodes first, then newest, then few relations, then ids."""
    return bundles.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("nodes", F.desc("newest"), "relations", "ids")))


def reviewed_decisions(proposals: DataFrame, reviews: DataFrame, pair: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, withheld): proposals whose review supports them and whose dates, if any, stand in their quote; and the rest with a reason."""
    met = proposals.join(reviews.select(F.col(pair).alias("_p"), "verdict"), F.col(pair) == F.col("_p"), "left").drop("_p")
    quoted = lambda c: F.col(c).isNull() | F.contains(F.coalesce("quote", F.lit("")), F.col(c))
    why = F.when(F.col("verdict").isNull(), "not_reviewed").when(F.col("verdict") != "supported", F.col("verdict")).when(~(quoted("valid_from") & quoted("valid_to")), "date_not_quoted")
    out = met.withColumn("reason", why)
    return out.where("reason is null").drop("reason", "verdict"), out.where("reason is not null").select(pair, "reason")


def acknowledged_history(log: DataFrame, run: str, seq: str, history: str, decision: str) -> DataFrame:
    """run and history: the last history that a row carries, then the decisions that came after it, in order."""
    last = log.where(F.col(history).isNotNull()).groupBy(F.col(run).alias("_r")).agg(F.max(seq).alias("_s"), F.max_by(history, seq).alias("_h"))
    met = log.join(last, F.col(run) == F.col("_r"), "left")
    later = met.where(F.col(decision).isNotNull() & (F.col("_s").isNull() | (F.col(seq) > F.col("_s")))).groupBy(F.col(run).alias("_q")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(decision).alias("d")))), lambda x: x["d"]).alias("_d"))
    none = F.expr("cast(array() as array<string>)")
    runs = log.select(run).distinct()
    return runs.join(last, F.col(run) == F.col("_r"), "left").join(later, F.col(run) == F.col("_q"), "left").select(run, F.concat(F.coalesce("_h", none), F.coalesce("_d", none)).alias("history"))


def node_violations(nodes: DataFrame, node: str) -> DataFrame:
    """node and reason: only documents carry text, and its digest is the text's."""
    doc = F.col("role") == "document"
    return _broken(nodes, [node], ("text_elsewhere", ~doc & (F.col("text").isNotNull() | F.col("text_sha256").isNotNull())), ("no_digest", doc & F.col("text").isNotNull() & F.col("text_sha256").isNull()), ("digest", doc & (F.sha2(F.col("text").cast("binary"), 256) != F.col("text_sha256"))))


def review_summaries(dimensions: DataFrame, review: str, item: str, verdict: str) -> DataFrame:
    """review, item, summary: the worst verdict of an item's dimensions."""
    return dimensions.groupBy(review, item).agg(F.collect_set(verdict).alias("_v")).select(review, item, worst_verdict(F.col("_v")).alias("summary"))


def review_violations(reviews: DataFrame, dimensions: DataFrame, findings: DataFrame, review: str, item: str) -> DataFrame:
    """review and reason: summaries follow from their dimensions; coverage is incomplete exactly if there are findings, all distinct.

    reviews: review, coverage; dimensions: review, item, verdict, summary; findings: review, digest.
    """
    own = review_summaries(dimensions, review, item, "verdict").withColumnRenamed("summary", "_own")
    wrong = dimensions.select(review, item, "summary").distinct().join(own, [review, item]).groupBy(review).agg(F.bool_or(F.col("summary") != F.col("_own")).alias("_wrong"))
    f = findings.groupBy(review).agg(F.count("*").alias("_n"), F.count_distinct("digest").alias("_d"))
    met = reviews.join(wrong, review, "left").join(f, review, "left")
    return _broken(met, [review], ("summary", F.col("_wrong")), ("witness", (F.col("coverage") == "incomplete") != (F.coalesce("_n", F.lit(0)) > 0)), ("repeated", F.col("_d") < F.col("_n")))


def bound_review_violations(proposals: DataFrame, reviews: DataFrame, parts: DataFrame, proposal: str) -> DataFrame:
    """proposal and reason: a review names the proposal's unchanged digest, and its parts cover the items 0 to n - 1 once each."""
    p = parts.groupBy(F.col(proposal).alias("_p")).agg(F.count("*").alias("_n"), F.count_distinct("item").alias("_u"), F.min("item").alias("_lo"), F.max("item").alias("_hi"))
    met = proposals.join(reviews.select(F.col(proposal).alias("_r"), F.col("digest").alias("_digest")), F.col(proposal) == F.col("_r"), "left").join(p, F.col(proposal) == F.col("_p"), "left")
    exact = (F.col("_n") == F.col("items")) & (F.col("_u") == F.col("items")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("items") - 1)
    return _broken(met, [proposal], ("not_reviewed", F.col("_r").isNull()), ("digest", F.col("_digest") != F.col("digest")), ("partition", ~F.coalesce(exact, F.lit(False))))


def proposal_violations(proposals: DataFrame, key: str, models: list[str], most_items: int) -> DataFrame:
    """key and reason: a proposal comes from a known model, is not too long, and its window lies inside its page."""
    return _broken(proposals, [key], ("model", ~F.col("model").isin(*models)), ("limit", F.col("items") > most_items), ("window", (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("chars"))))


def window_violations(windows: DataFrame, mentions: DataFrame, entities: DataFrame, excluded: DataFrame, window: str) -> DataFrame:
    """window and reason: every mention is an entity or excluded, never both; it lies inside its window and its label is what it quotes."""
    e = entities.select(window, "mention").distinct().withColumn("_e", F.lit(True))
    x = excluded.select(window, "mention").distinct().withColumn("_x", F.lit(True))
    met = mentions.join(e, [window, "mention"], "full_outer").join(x, [window, "mention"], "full_outer").join(windows.select(window, F.col("start").alias("_s"), F.col("end").alias("_t"), "text"), window, "left")
    quote = F.expr("substring(text, cast(start - _s + 1 as int), cast(end - start as int))")
    return _broken(met, [window, "mention"], ("unknown_mention", F.col("label").isNull()), ("both", F.col("_e") & F.col("_x")), ("neither", F.col("_e").isNull() & F.col("_x").isNull()), ("outside", (F.col("start") < F.col("_s")) | (F.col("end") > F.col("_t"))), ("label", F.col("label") != quote))


def transcription_violations(pages: DataFrame, reviews: DataFrame, page: str) -> DataFrame:
    """page and reason: line reviews cover the lines 0 to n - 1 once each, and a page is accepted exactly if none is uncertain."""
    r = reviews.groupBy(F.col(page).alias("_p")).agg(F.count("*").alias("_n"), F.count_distinct("line").alias("_u"), F.min("line").alias("_lo"), F.max("line").alias("_hi"), F.bool_or("uncertain").alias("_unsure"))
    met = pages.join(r, F.col(page) == F.col("_p"), "left")
    exact = (F.col("_n") == F.col("lines")) & (F.col("_u") == F.col("lines")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("lines") - 1)
    return _broken(met, [page], ("lines", ~F.coalesce(exact, F.lit(False))), ("accepted", F.col("accepted") == F.col("_unsure")))


def view_violations(references: DataFrame, edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """id and reason: a planning view is closed: references and ends of edges are among its nodes, and nodes come from its sources."""
    have = nodes.select(F.col("node").alias("_n")).distinct()
    lost = lambda df, c, why: df.join(have, F.col(c) == F.col("_n"), "left_anti").select(F.col(c).alias("id"), F.lit(why).alias("reason"))
    stray = nodes.join(sources.select(F.col("source").alias("_s")).distinct(), F.col("source") == F.col("_s"), "left_anti").select(F.col("node").alias("id"), F.lit("source").alias("reason"))
    return lost(references, "ref", "reference").union(lost(edges, "source", "edge_source")).union(lost(edges, "target", "edge_target")).union(stray).distinct()


# Logs


def version_chain_violations(versions: DataFrame, seq: str) -> DataFrame:
    """seq and reason: a store's versions are numbered from 0, each names the one before it, and none was captured earlier than that.

    versions also names its store; each store's chain is one window.
    """
    w = W.partitionBy("store").orderBy(seq)
    out = versions.withColumn("_n", F.row_number().over(w) - 1).withColumn("_p", F.lag("id").over(w)).withColumn("_c", F.lag("captured").over(w))
    return _broken(out, ["store", seq], ("sequence", F.col(seq) != F.col("_n")), ("parent", ~F.col("parent").eqNullSafe(F.col("_p"))), ("captured", F.col("captured") < F.col("_c")), ("identity", ~F.col("id").rlike("^[0-9a-f]{64}$")))


def batch_chain_violations(batches: DataFrame, run: str, seq: str) -> DataFrame:
    """run, seq and reason: a run's graph batches follow one another and each names the digest of the one before; the first names none."""
    w = W.partitionBy(run).orderBy(seq)
    out = batches.withColumn("_s", F.lag(seq).over(w)).withColumn("_d", F.lag("digest").over(w))
    return _broken(out, [run, seq], ("sequence", F.col(seq) != F.coalesce(F.col("_s") + 1, F.lit(0))), ("previous", ~F.col("previous").eqNullSafe(F.col("_d"))))


def reservation_violations(log: DataFrame, run: list[str], seq: str, operation: str, step: str) -> DataFrame:
    """run, operation and reason: a reservation comes once and first, at most one acknowledgement and then replays follow, and a
    replay's output is the acknowledged one. Columns beside: output. One pass: each operation's rows are one group."""
    k = F.col(step)
    at = lambda name, f: f(F.when(k == name, F.col(seq)))
    g = log.groupBy(*run, operation).agg(
        F.count_if(k == "reserve").alias("_r"), F.count_if(k == "ack").alias("_a"), at("reserve", F.min).alias("_rs"), at("ack", F.min).alias("_as"), at("replay", F.min).alias("_ps"),
        F.max(F.when(k == "ack", F.col("output"))).alias("_ao"), F.min(F.when(k == "replay", F.col("output"))).alias("_lo"), F.max(F.when(k == "replay", F.col("output"))).alias("_hi"),
    )
    return _broken(g, [*run, operation], ("no_reservation", F.col("_r") == 0), ("reserved_again", F.col("_r") > 1), ("acknowledged_again", F.col("_a") > 1), ("order", (F.col("_as") < F.col("_rs")) | (F.col("_ps") < F.coalesce("_as", F.col("_rs")))), ("replay_unanswered", F.col("_as").isNull() & F.col("_ps").isNotNull()), ("output", (F.col("_lo") != F.col("_ao")) | (F.col("_hi") != F.col("_ao"))))


def invocation_violations(log: DataFrame, run: str, seq: str) -> DataFrame:
    """run, seq and reason: model calls are reserved under numbers from 0 on without a gap, and only after the call before was answered.

    log: kind (reserve or ack) and number.
    """
    w = W.partitionBy(run).orderBy(seq)
    reserved = F.col("kind") == "reserve"
    n = F.sum(F.when(reserved, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    out = log.withColumn("_n", n).withColumn("_k", F.lag("kind").over(w))
    return _broken(out, [run, seq], ("number", F.col("number") != F.col("_n")), ("pending", reserved & (F.col("_k") == "reserve")), ("unreserved", ~reserved & ((F.col("_k") == "ack") | F.col("_k").isNull())))


def reconciliation_violations(decisions: DataFrame, intents: DataFrame, answers: DataFrame, run: list[str], intent: str) -> DataFrame:
    """run, intent and reason: a decision is about an intent of the run that nothing answered, once."""
    key = [*run, intent]
    d = decisions.groupBy(*key).agg(F.count("*").alias("_n"))
    met = d.join(intents.select(*key).distinct().withColumn("_i", F.lit(True)), key, "left").join(answers.select(*key).distinct().withColumn("_a", F.lit(True)), key, "left")
    return _broken(met, key, ("unknown", F.col("_i").isNull()), ("answered", F.col("_a")), ("repeated", F.col("_n") > 1))


def seal_violations(log: DataFrame, seals: DataFrame, run: str, seq: str) -> DataFrame:
    """run and reason: a seal (rows, last_digest, bytes, judge_calls) is what the log adds up to, and the log ends with a stop.

    log: event, digest, bytes; which events are judge calls is the caller's column judged.
    """
    g = log.groupBy(F.col(run).alias("_r")).agg(F.count("*").alias("_n"), F.max_by("digest", seq).alias("_d"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("_b"), F.count_if("judged").alias("_j"), F.max_by("event", seq).alias("_e"))
    met = seals.join(g, F.col(run) == F.col("_r"), "left")
    return _broken(met, [run], ("rows", F.coalesce("_n", F.lit(0)) != F.col("rows")), ("last_digest", ~F.col("_d").eqNullSafe(F.col("last_digest"))), ("bytes", F.col("_b") != F.col("bytes")), ("judge_calls", F.col("_j") != F.col("judge_calls")), ("stop", F.col("_e") != "stop"))


def fetch_attempts(log: DataFrame, run: str, guarded: bool) -> DataFrame:
    """run and attempts: rows with a browser action, challenges, reserved fetches, and plain fetches (under a guard not the browser's own)."""
    plain = (F.col("event") == "fetch") & F.col("query_ack").isNull() & F.lit(not guarded).__or__(F.coalesce(F.col("route") != "human_browser_dom", F.lit(True)))
    hit = F.col("browser_action").isNotNull() | (F.col("event") == "challenge") | F.col("fetch_reservation").isNotNull() | plain
    return log.groupBy(run).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("attempts"))


def notice_violations(notices: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """document and reason: a notice of a kept source names a document that is there, with its own url and digest."""
    d = documents.select(F.col(document).alias("_d"), F.col("url").alias("_u"), F.col("sha256").alias("_s"))
    met = notices.join(d, F.col(document) == F.col("_d"), "left")
    return _broken(met, [document], ("unknown", F.col("_d").isNull()), ("url", F.col("url") != F.col("_u")), ("content", F.col("sha256") != F.col("_s")))


def retained_violations(rows: DataFrame, run: str, seq: str) -> DataFrame:
    """run, seq and reason: what is kept from before stands before all that is new, and nothing kept leans on something new.

    rows: retained, id, leans_on (an id or null).
    """
    first_new = F.min(F.when(~F.col("retained"), F.col(seq))).over(W.partitionBy(run))
    new = rows.where("not retained").select(F.col(run).alias("_r"), F.col("id").alias("_i")).distinct()
    met = rows.withColumn("_f", first_new).join(new, (F.col(run) == F.col("_r")) & (F.col("leans_on") == F.col("_i")), "left")
    return _broken(met, [run, seq], ("late", F.col("retained") & (F.col(seq) > F.col("_f"))), ("leans_on_new", F.col("retained") & F.col("_i").isNotNull()))


def reference_row_violations(scores: DataFrame, declared: DataFrame, run: str, seq: str) -> DataFrame:
    """run, seq and reason: a score's reference was declared earlier in its run, with the same digest."""
    d = declared.groupBy(F.col(run).alias("_r"), F.col("reference").alias("_f")).agg(F.min(seq).alias("_s"), F.min_by("digest", seq).alias("_d"))
    met = scores.join(d, (F.col(run) == F.col("_r")) & (F.col("reference") == F.col("_f")), "left")
    return _broken(met, [run, seq], ("undeclared", F.col("_f").isNull()), ("later", F.col("_s") > F.col(seq)), ("digest", F.col("digest") != F.col("_d")))


def failed_windows(windows: DataFrame, run: str, seq: str, failed: Column, budget: int) -> DataFrame:
    """windows and status: done, continued (a failure within the budget), stopped (the failure beyond it) or not_reached."""
    w = W.partitionBy(run).orderBy(seq)
    before = F.coalesce(F.sum(F.when(failed, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = windows.withColumn("_b", before)
    return out.withColumn("status", F.when(F.col("_b") > budget, "not_reached").when(~failed, "done").when(F.col("_b") < budget, "continued").otherwise("stopped")).drop("_b")


def replayed(claimed: DataFrame, recomputed: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and reason: rows that a log claims and its recomputation lacks or gives another value, and rows it should have."""
    a, b = claimed.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_x")), recomputed.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_y"))
    return _broken(a.join(b, key, "full_outer"), key, ("unfounded", F.col("_y").isNull()), ("missing", F.col("_x").isNull()), ("differs", ~F.col("_a").eqNullSafe(F.col("_b"))))
