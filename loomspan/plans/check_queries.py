"""Registered queries on validators and smaller rules, with equivalent DuckDB SQL.

Rows of the tables stand for records; faults are put in by arithmetic, so each rule has rows that keep it and rows that break it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import filters as A
from ..operators import graph as G
from ..operators import records as R
from ..operators import scoring as C
from ..sources.shared import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _sha(c):
    return F.sha2(c.cast("string").cast("binary"), 256)


@query(
    """with r as (select event_id, 'h' || event_id * 7 % 60 as host from events), k as (select *, substr(host, 2)::int % 5 = 0 as c, substr(host, 2)::int % 7 = 3 as d from r),
f as (select host from (select host, min(event_id) as s from k where not c and not d group by host) order by s, host limit 10)
select event_id, case when d then 'denied' when c then 'configured' when host in (select host from f) then 'expanded' else 'host_limit' end as decision from k"""
)
def host_expansion(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "concat('h', event_id * 7 % 60) as host")
    hosts = spark.range(60).selectExpr("concat('h', id) as host", "id")
    return K.host_expansion(e, "host", "event_id", hosts.where("id % 5 = 0"), hosts.where("id % 7 = 3"), 10).select("event_id", "decision")


@query("select event_id, case when event_type = 'error' and event_id % 3 = 0 then 'kept_by_client:off topic' else 'off topic' end as reason, case when event_type = 'error' and event_id % 3 = 0 then 'keep' else 'hold' end as action, event_id % 4 in (1, 3) as ends from events")
def kept_readings(spark, sf_dir):
    """Rejected pages that the client keeps, and refusals that end a run."""
    refusal = F.when(F.col("event_id") % 4 == 1, "graph_contract").when(F.col("event_id") % 4 == 3, "ledger_sink_failed").when(F.col("event_id") % 4 == 2, "fetch_timeout")
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "reject").otherwise("accept").alias("decision"), F.lit("off topic").alias("reason"), F.lit("hold").alias("action"), K.ends_run(refusal).alias("ends"))
    return K.kept_readings(e, F.col("event_id") % 3 == 0).select("event_id", "reason", "action", "ends")


@query("with n as (select case when event_id % 50 = 0 then '' when event_id % 50 = 1 then 'Utm_' || user_id when event_id % 50 = 2 then 'a&' || user_id else 'p' || event_id // 2 end as name from events), g as (select name, count(*) as n from n group by name) select name, reason from (select name, case when trim(name) = '' then 'blank' when contains(name, '&') then 'mark' when name <> lower(name) then 'case' when n > 1 then 'repeated' end as reason from g) where reason is not null")
def tracking_violations(spark, sf_dir):
    n = table(spark, sf_dir, "events").selectExpr("case when event_id % 50 = 0 then '' when event_id % 50 = 1 then concat('Utm_', user_id) when event_id % 50 = 2 then concat('a&', user_id) else concat('p', event_id div 2) end as name")
    return K.tracking_violations(n, "name")


@query(
    """with i as (select conv_id, case when conv_id % 11 = 0 and turn = 1 then 0 else turn end as item, case when conv_id % 13 = 1 and turn = 0 then ' ' else role end as text, case when conv_id % 5 = 2 then 'z' else 'k' || turn end as ref from conversations),
g as (select conv_id, count(*) as n, count(distinct item) as u, bool_or(trim(text) = '') as blank, max(length(text)) as long, bool_or(ref = 'z' or try_cast(substr(ref, 2) as int) >= 40) as lost from i group by conv_id)
select conv_id, reason from (select conv_id, case when u < n then 'repeated_id' when n > 7 then 'limit' when blank then 'blank' when long > 8 then 'length' when lost then 'reference' end as reason from g) where reason is not null"""
)
def plan_violations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    i = c.select("conv_id", F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 1), 0).otherwise(F.col("turn")).alias("item"), F.when((F.col("conv_id") % 13 == 1) & (F.col("turn") == 0), " ").otherwise(F.col("role")).alias("text"), F.array(F.when(F.col("conv_id") % 5 == 2, "z").otherwise(F.concat(F.lit("k"), "turn"))).alias("refs"))
    known = spark.range(40).selectExpr("concat('k', id) as ref")
    return K.plan_violations(i, "conv_id", "item", "text", "refs", known, 7, 8)


_HITS = "select event_id, event_type as q, 'u' || event_id * 13 % 400 as url, 'h' || (event_id * 13 % 400) % 25 as host from events"


@query(f"with h as ({_HITS}), f as (select host from (select host, min(event_id) as s from h group by host) order by s, host limit 8), k as (select * from h where host in (select host from f)) select url, min(event_id) as first_seq, arg_min(q, event_id) as first_query, count(distinct q) as queries from k group by url")
def discovery_trace(spark, sf_dir):
    h = table(spark, sf_dir, "events").selectExpr("event_id", "event_type as q", "concat('u', event_id * 13 % 400) as url", "concat('h', (event_id * 13 % 400) % 25) as host")
    urls, trace = K.discovery_trace(h, "q", "url", "host", "event_id", 8)
    return urls.join(trace.groupBy("url").agg(F.count("*").alias("queries")), "url")


@query("select distinct sha256('{\"relation\":\"discovered\",\"source\":\"' || event_type || '\",\"target\":' || event_id % 300 || '}') as digest from events")
def trace_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 300).alias("t"))
    return K.trace_edges(e, "discovered", "event_type", "t").select(F.substring_index("id", ":", -1).alias("digest"))


@query("with n as (select *, sum((event_type <> 'click')::int) over (partition by user_id order by event_id) as n from events) select user_id, min(event_id) as stop_seq from n where event_type <> 'click' and n % 5 = 0 and event_id % 3 <> 0 and value >= 40 group by user_id")
def grade_stops(spark, sf_dir):
    return K.grade_stop(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "click", F.col("event_id") % 3 != 0, F.col("value"), 5, 40.0)


@query(
    """with c as (select conv_id, turn, case when conv_id % 7 = 5 and turn = 0 then 'ambiguous' else 'supported' end as v, not (conv_id % 9 = 4 and turn = 1) as cited from conversations where not (conv_id % 8 = 3 and turn = 0)),
g as (select conv_id, count(*) as n, count(distinct turn) as k, bool_and(v = 'supported') as ok, bool_and(cited) as ci from c group by conv_id),
r as (select conv_id, case when conv_id % 5 = 0 then 'partial' else 'answered' end as status, case when conv_id % 10 = 5 then 0 else count(*) end as claims, case when conv_id % 17 = 2 then 'budget' else 'answered' end as stop, (conv_id % 19 = 6)::int as unresolved, conv_id % 23 <> 7 as intent, conv_id % 10 / 10.0 as conf from conversations group by conv_id)
select conv_id, reason from (select r.conv_id, case when status <> 'answered' and claims > 0 then 'partial_with_answer' when status <> 'answered' then null when stop <> 'answered' then 'stop' when unresolved > 0 then 'unresolved' when not intent then 'intent' when coalesce(n, 0) <> claims or k <> claims then 'coverage' when not ok then 'unsupported' when not ci then 'citation' when conf < 0.3 then 'confidence' end as reason from r left join g using (conv_id)) where reason is not null"""
)
def result_violations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    claims = c.where("not (conv_id % 8 = 3 and turn = 0)").select("conv_id", F.col("turn").alias("claim"), F.when((F.col("conv_id") % 7 == 5) & (F.col("turn") == 0), "ambiguous").otherwise("supported").alias("verdict"), (~((F.col("conv_id") % 9 == 4) & (F.col("turn") == 1))).alias("cited"))
    r = c.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr("conv_id", "if(conv_id % 5 = 0, 'partial', 'answered') as status", "if(conv_id % 10 = 5, 0, n) as claims", "if(conv_id % 17 = 2, 'budget', 'answered') as stop_reason", "if(conv_id % 19 = 6, 1, 0) as unresolved", "conv_id % 23 <> 7 as intent_covered", "conv_id % 10 / 10.0 as confidence")
    return K.result_violations(r, claims, "conv_id", 0.3)


@query(
    """with e as (select vec_id, embedding::double[] as v, label from embeddings),
m as (select q.vec_id as query, p.vec_id as passage, greatest(-1, least(1, list_dot_product(p.v, q.v))) as c from e p, e q where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query order by c desc, passage) as n from m)
select query, passage, round(c, 6) as cosine, (row_number() over (partition by query order by n))::int as rank from r where n <= 40 and c >= 0.1 and passage % 3 <> 0 qualify row_number() over (partition by query order by n) <= 5"""
)
def corpus_search(spark, sf_dir):
    """The whole search over passages whose texts share no word with any query, so that the fused order is the vectors'; fusion by both lists is hybrid_rrf."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select(F.col("vec_id").alias("passage"), F.concat(F.lit("p"), "vec_id").alias("text"), F.when(F.col("vec_id") % 3 == 0, "xx").otherwise("en").alias("lang"), F.col("embedding").alias("vector"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.lit("unmet").alias("text"), F.col("embedding").alias("vector"))
    return K.search(p, q, 40, 0.1, 5, ["en"]).select("query", "passage", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    """with h as (select user_id, row_number() over (partition by user_id order by event_id) as n from events), x as (select user_id, n + (user_id % 9 = 2 and n >= 5)::int as rank, n as v, n % 50 = 7 as gone from h),
f as (select user_id, rank, case when gone then null else v end as v, case when gone then 0.0 else 1.0 / (60 + v) end + case when user_id % 9 = 4 and rank = 3 then 0.5 else 0 end as fused from x)
select user_id, rank::int as rank, reason from (select user_id, rank, case when rank <> row_number() over w then 'rank' when v is null then 'unlisted' when user_id % 9 = 4 and rank = 3 then 'fused' when fused > lag(fused) over w then 'order' end as reason from f window w as (partition by user_id order by rank)) where reason is not null"""
)
def query_evidence(spark, sf_dir):
    from pyspark.sql import Window as W

    h = table(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("n"))
    v = F.when(F.col("n") % 50 != 7, F.col("n"))
    fused = F.coalesce(1.0 / (60 + v), F.lit(0.0))
    rank = F.col("n") + ((F.col("user_id") % 9 == 2) & (F.col("n") >= 5)).cast("int")
    x = h.select("user_id", rank.alias("rank"), v.alias("v"), F.lit(None).cast("int").alias("t"), (fused + F.when((F.col("user_id") % 9 == 4) & (rank == 3), 0.5).otherwise(0.0)).alias("fused"))
    return K.query_evidence_violations(x, "user_id", "rank", "v", "t", "fused")


@query("select (select count(*) from documents) as documents, count(*) as passages, sum(length(text))::bigint as characters, count(*) > 100 or (select count(*) from documents) > 100000 as over_capacity from conversations")
def corpus_counts(spark, sf_dir):
    return K.corpus_counts(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents"), 100, 100000)


@query("select source, count(distinct lang) as documents, sum(length(text))::bigint as characters from (select distinct source, lang, text from documents) group by source")
def evidence_sizes(spark, sf_dir):
    return K.evidence_size(table(spark, sf_dir, "documents"), "source", "lang", "text")


@query("with r as (select conv_id, count(*) as n from conversations group by conv_id) select conv_id, case when conv_id % 6 = 1 then 'documents' when conv_id % 6 = 2 then 'passages' when conv_id % 6 = 3 then 'encoded' end as reason from r where conv_id % 6 in (1, 2, 3)")
def append_receipts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr("conv_id", "2 as added_documents", "if(conv_id % 6 = 1, 1, 5) as total_documents", "n as added_passages", "if(conv_id % 6 = 2, n - 1, n + 4) as total_passages")
    return K.append_receipt_violations(r, c.selectExpr("conv_id", "if(conv_id % 6 = 3 and turn = 0, 2, 1) as inputs"), "conv_id")


@query("with a as (select conv_id, count(*) as n from conversations group by conv_id) select conv_id, case when n > 7 then 'limit' when conv_id % 5 = 1 and n > 1 then 'repeated' when conv_id % 5 = 2 then 'sources' end as reason from a where n > 7 or (conv_id % 5 = 1 and n > 1) or conv_id % 5 = 2")
def lead_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    leads = c.selectExpr("conv_id", "if(conv_id % 5 = 1 and turn = 1, 's0', concat('s', turn)) as source")
    p = c.selectExpr("conv_id", "if(conv_id % 5 = 2 and turn = 0, 'other', if(conv_id % 5 = 1 and turn = 1, 's0', concat('s', turn))) as source")
    return K.lead_record_violations(leads, p.union(p), "conv_id", 7)


@query("with s as (select doc_id, length(text) // 3 as s, length(text) // 3 + 40 as e, text from documents where length(text) >= 120) select doc_id, sha256(substr(text, s + 1, 40)) as digest, (s <= 45 and 45 + 5 <= e)::int + (s <= length(text) // 3 + 10 and length(text) // 3 + 20 <= e)::int as anchors from s")
def exact_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) >= 120")
    spans = d.selectExpr("doc_id", "length(text) div 3 as start", "length(text) div 3 + 40 as end")
    anchors = d.selectExpr("doc_id", "inline(array(struct(45L as start, 50L as end), struct(length(text) div 3 + 10 as start, length(text) div 3 + 20 as end), struct(0L as start, 1000000L as end)))")
    return K.exact_windows(spans, d, "doc_id", "text", anchors).select("doc_id", "digest", "anchors")


@query("select doc_id, case when doc_id % 7 = 3 then 'no_window' when doc_id % 7 = 4 then 'range' when doc_id % 7 = 5 then 'reference' when doc_id % 7 = 6 then 'maximum' end as reason from documents where doc_id % 7 >= 3")
def similarity_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = d.where("doc_id % 7 <> 3").selectExpr("doc_id", "inline(array(struct(if(doc_id % 7 = 4, 1.5D, 0.25D) as cosine, 0 as reference), struct(0.5D as cosine, if(doc_id % 7 = 5, 9, 1) as reference)))")
    return K.similarity_violations(w, d.selectExpr("doc_id", "if(doc_id % 7 = 6, 0.25D, if(doc_id % 7 = 4, 1.5D, 0.5D)) as cosine"), "doc_id", 3)


@query("with p as (select conv_id, turn, length(text) as n, (role <> 'user')::int as k from conversations) select conv_id, turn, (sum(n + 2) over w - 2 - n)::bigint as start, (sum(n + 2) over w - 2)::bigint as \"end\" from p window w as (partition by conv_id order by k, turn)")
def joined_readings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", (F.col("role") != "user").cast("int"))
    return K.joined_reading(c, "conv_id", "k", "turn", "text").select("conv_id", "turn", "start", "end")


@query("select doc_id, case when doc_id % 5 = 1 then 'digest' when doc_id % 2 = 0 and length(text) < 200 then 'tier' when doc_id % 5 = 2 then 'omitted' end as reason from documents where text is not null and (doc_id % 5 in (1, 2) or (doc_id % 2 = 0 and length(text) < 200))")
def extraction_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    r = d.select("doc_id", "text", F.when(F.col("doc_id") % 5 == 1, "x").otherwise(_sha(F.col("text"))).alias("text_sha256"), F.when(F.col("doc_id") % 2 == 0, "fast").otherwise("rich").alias("tier"), F.lit(7).alias("omitted_chars"), (F.length("text") + F.when(F.col("doc_id") % 5 == 2, 6).otherwise(7)).alias("whole_chars"))
    return K.extraction_violations(r, "doc_id", 200)


@query("select page_id, 'cite:' || sha256('{\"document\":' || page_id || ',\"quote\":\"q\"}') as id from pages")
def citation_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.citation_id(F.struct(F.col("page_id").alias("document"), F.lit("q").alias("quote"))).alias("id"))


@query("select conv_id, turn, conv_id || ':' || turn * 10 || ':' || (turn * 10 + turn) as node_id from conversations where turn > 0")
def visual_nodes(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct((F.col("turn") * 10).alias("start"), (F.col("turn") * 11).alias("end"))).alias("s"))
    return K.visual_nodes(r.union(r), "conv_id", "s").selectExpr("conv_id", "start div 10 as turn", "node_id")


@query("select user_id, event_id, (row_number() over (partition by user_id order by event_id % 4, event_id % 10 desc, event_id % 3, event_id))::int as rank from events")
def bundle_order(spark, sf_dir):
    b = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id % 4 as nodes", "event_id % 10 as newest", "event_id % 3 as relations", "event_id as ids")
    return K.bundle_order(b, "user_id").select("user_id", "event_id", "rank")


@query("select event_id, coalesce(case when event_id % 5 = 4 then 'not_reviewed' when event_id % 5 = 3 then 'ambiguous' when event_id % 4 = 1 then 'date_not_quoted' end, 'decided') as outcome from events")
def reviewed_decisions(spark, sf_dir):
    """Proposals become decisions, or are withheld with a reason."""
    e = table(spark, sf_dir, "events")
    p = e.selectExpr("event_id", "if(event_id % 4 in (1, 2), '2020-01-01', null) as valid_from", "cast(null as string) as valid_to", "if(event_id % 4 = 2, 'since 2020-01-01 here', 'since then') as quote")
    r = e.where("event_id % 5 <> 4").selectExpr("event_id", "if(event_id % 5 = 3, 'ambiguous', 'supported') as verdict")
    decided, withheld = K.reviewed_decisions(p, r, "event_id")
    return decided.select("event_id", F.lit("decided").alias("outcome")).union(withheld.select("event_id", "reason"))


@query(
    """with l as (select user_id, event_id from events where event_type = 'signup'), m as (select user_id, max(event_id) as s from l group by user_id),
d as (select e.user_id, string_agg('d' || event_id, ',' order by event_id) as d from events e left join m using (user_id) where event_type = 'purchase' and (s is null or event_id > s) group by e.user_id)
select u.user_id, concat_ws(',', 'h' || s, d) as history from (select distinct user_id from events) u left join m using (user_id) left join d using (user_id)"""
)
def acknowledged_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.array(F.concat(F.lit("h"), "event_id"))).alias("h"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("d"), "event_id")).alias("d"))
    return K.acknowledged_history(e, "user_id", "event_id", "h", "d").select("user_id", F.array_join("history", ",").alias("history"))


@query("select doc_id, case when doc_id % 6 = 1 then 'text_elsewhere' when doc_id % 6 = 2 then 'no_digest' when doc_id % 6 = 3 then 'digest' end as reason from documents where text is not null and doc_id % 6 in (1, 2, 3)")
def node_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    n = d.select("doc_id", F.when(F.col("doc_id") % 6 == 1, "source").otherwise("document").alias("role"), "text", F.when(F.col("doc_id") % 6 == 2, None).when(F.col("doc_id") % 6 == 3, "x").otherwise(_sha(F.col("text"))).alias("text_sha256"))
    return K.node_violations(n, "doc_id")


@query(
    """with d as (select conv_id, turn // 2 as item, case when turn % 7 = 5 then 'unsupported' when turn % 5 = 3 then 'ambiguous' else 'supported' end as v from conversations),
s as (select conv_id, item, case when bool_or(v = 'unsupported') then 'unsupported' when bool_or(v = 'ambiguous') then 'ambiguous' else 'supported' end as own from d group by all), w as (select conv_id, bool_or(own <> case when conv_id % 4 = 1 then 'supported' else own end) as wrong from s group by conv_id)
select conv_id, reason from (select conv_id, case when wrong then 'summary' when conv_id % 4 = 2 then 'witness' when conv_id % 4 = 3 then 'repeated' end as reason from w) where reason is not null"""
)
def grounded_reviews(spark, sf_dir):
    """Summaries that don't follow, incomplete coverage without a witness, and a witness given twice."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn div 2 as item", "case when turn % 7 = 5 then 'unsupported' when turn % 5 = 3 then 'ambiguous' else 'supported' end as verdict")
    told = K.review_summaries(c, "conv_id", "item", "verdict").withColumn("summary", F.when(F.col("conv_id") % 4 == 1, "supported").otherwise(F.col("summary")))
    r = c.select("conv_id").distinct().withColumn("coverage", F.when(F.col("conv_id") % 4 >= 2, "incomplete").otherwise("complete"))
    f = r.where("conv_id % 4 = 3").select("conv_id", F.lit("w").alias("digest"))
    return K.review_violations(r, c.join(told, ["conv_id", "item"]), f.union(f), "conv_id", "item")


@query("select conv_id, reason from (select conv_id, case when conv_id % 7 = 1 then 'not_reviewed' when conv_id % 7 = 2 then 'digest' when conv_id % 7 = 3 and count(*) > 1 then 'partition' end as reason from conversations group by conv_id) where reason is not null")
def bound_reviews(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = c.groupBy("conv_id").agg(F.count("*").alias("items")).withColumn("digest", F.concat(F.lit("p"), "conv_id"))
    r = p.where("conv_id % 7 <> 1").select("conv_id", F.when(F.col("conv_id") % 7 == 2, "x").otherwise(F.col("digest")).alias("digest"))
    return K.bound_review_violations(p, r, c.selectExpr("conv_id", "if(conv_id % 7 = 3 and turn = 1, 0, turn) as item"), "conv_id")


@query("select doc_id, case when doc_id % 9 = 1 then 'model' when doc_id % 12 > 10 then 'limit' when doc_id % 5 = 2 then 'window' end as reason from documents where doc_id % 9 = 1 or doc_id % 12 > 10 or doc_id % 5 = 2")
def proposal_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 9 = 1, 'other', 'm') as model", "doc_id % 12 as items", "if(doc_id % 5 = 2, 90, 10) as start", "if(doc_id % 5 = 2, 120, 80) as end", "100 as chars")
    return K.proposal_violations(d, "doc_id", ["m"], 10)


@query(
    """with m as (select conv_id, turn, substr(text, 1, 3) as q from conversations where length(text) >= 3)
select conv_id, turn as mention, reason from (select conv_id, turn, case when turn % 6 = 1 then 'both' when turn % 6 = 2 then 'neither' when turn % 6 = 3 then 'outside' when turn % 6 = 4 then 'label' end as reason from m) where reason is not null"""
)
def window_checks(spark, sf_dir):
    """Mentions of windows of texts, each window one turn."""
    c = table(spark, sf_dir, "conversations").where("length(text) >= 3").withColumn("w", F.struct("conv_id", "turn"))
    windows = c.select("w", F.lit(5).alias("start"), (F.length("text") + 5).alias("end"), "text")
    m = c.select("w", F.col("turn").alias("mention"), F.when(F.col("turn") % 6 == 3, 4).otherwise(5).alias("start"), F.lit(8).alias("end"), F.when(F.col("turn") % 6 == 4, "\u0000\u0000\u0000").otherwise(F.substring("text", 1, 3)).alias("label"))
    out = K.window_violations(windows, m, c.where("turn % 6 <> 2").select("w", F.col("turn").alias("mention")), c.where("turn % 6 = 1").select("w", F.col("turn").alias("mention")), "w")
    return out.select("w.conv_id", "mention", "reason")


@query("select conv_id, reason from (select conv_id, case when conv_id % 6 = 1 and count(*) > 1 then 'lines' when (conv_id % 4 <> 0) = bool_or(turn % 5 = 4) then 'accepted' end as reason from conversations group by conv_id) where reason is not null")
def transcription_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = c.groupBy("conv_id").agg(F.count("*").alias("lines")).withColumn("accepted", F.col("conv_id") % 4 != 0)
    return K.transcription_violations(p, c.selectExpr("conv_id", "if(conv_id % 6 = 1 and turn = 1, 0, turn) as line", "turn % 5 = 4 as uncertain"), "conv_id")


@query("select distinct id, reason from (select 'n' || event_id % 120 as id, 'reference' as reason from events where event_id % 120 >= 100 union all select 'n' || user_id % 130, 'edge_source' from events where user_id % 130 >= 100 union all select 'n' || event_id * 7 % 110, 'edge_target' from events where event_id * 7 % 110 >= 100 union all select 'n' || range, 'source' from range(100) where range % 9 = 5)")
def planning_views(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nodes = spark.range(100).selectExpr("concat('n', id) as node", "concat('s', id % 9) as source")
    sources = spark.range(9).where("id <> 5").selectExpr("concat('s', id) as source")
    return K.view_violations(e.selectExpr("concat('n', event_id % 120) as ref"), e.selectExpr("concat('n', user_id % 130) as source", "concat('n', event_id * 7 % 110) as target"), nodes, sources)


@query(
    """with v as (select user_id as store, row_number() over (partition by user_id order by event_id) - 1 as n, event_id, sha256(event_id::varchar) as id from events), p as (select *, lag(id) over (partition by store order by n) as prev from v)
select store, seq, reason from (select store, n + (store % 11 = 3 and n >= 4)::int as seq, case when store % 11 = 3 and n >= 4 then 'sequence' when store % 11 = 4 and n = 2 then 'parent' when store % 11 = 5 and n = 3 then 'captured' when store % 11 = 6 and n = 1 then 'identity' when store % 11 = 6 and n = 2 then null end as reason from p) where reason is not null"""
)
def version_chains(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("store").orderBy("n")
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("store"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("n"), "event_id")
    v = v.withColumn("id", F.when((F.col("store") % 11 == 6) & (F.col("n") == 1), "X").otherwise(_sha(F.col("event_id"))))
    v = v.withColumn("parent", F.when((F.col("store") % 11 == 4) & (F.col("n") == 2), "x").otherwise(F.lag("id").over(w))).withColumn("captured", F.when((F.col("store") % 11 == 5) & (F.col("n") == 3), -1.0).otherwise(F.col("n").cast("double")))
    return K.version_chain_violations(v.withColumn("seq", F.col("n") + ((F.col("store") % 11 == 3) & (F.col("n") >= 4)).cast("int")), "seq")


@query("with b as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as n from events) select user_id, seq, reason from (select user_id, n + (user_id % 7 = 2 and n >= 3)::int as seq, case when user_id % 7 = 2 and n = 3 then 'sequence' when user_id % 7 = 4 and n = 2 then 'previous' end as reason from b) where reason is not null")
def batch_chains(spark, sf_dir):
    from pyspark.sql import Window as W

    b = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("n"))
    b = b.withColumn("digest", _sha(F.concat_ws(":", "user_id", "n")))
    b = b.withColumn("previous", F.when((F.col("user_id") % 7 == 4) & (F.col("n") == 2), "x").otherwise(F.lag("digest").over(W.partitionBy("user_id").orderBy("n"))))
    return K.batch_chain_violations(b.withColumn("seq", F.col("n") + ((F.col("user_id") % 7 == 2) & (F.col("n") >= 3)).cast("int")), "user_id", "seq")


def _reservations(spark, sf_dir, runs: str):
    """Three rows for each operation of a run: reserved, acknowledged, replayed; with faults."""
    o = table(spark, sf_dir, "conversations").where(runs).select("conv_id", "turn")
    steps = o.selectExpr("conv_id", "turn", "posexplode(array('reserve', 'ack', 'replay')) as (i, step)").where("not (turn % 9 = 1 and step = 'reserve') and not (turn % 9 = 2 and step = 'ack') and not (turn % 9 = 6 and step <> 'reserve')")
    rows = steps.selectExpr("conv_id", "turn", "step", "turn * 10 + if(turn % 9 = 3 and step = 'ack', -5, i) as seq", "if(turn % 9 = 4 and step = 'replay', 'other', 'o') as output")
    again = rows.where("turn % 9 = 5 and step = 'reserve'").withColumn("seq", F.col("seq") + 7)
    return K.reservation_violations(rows.union(again), ["conv_id"], "seq", "turn", "step").select("conv_id", "turn", "reason")


def _reservation_sql(runs: str) -> str:
    return f"select conv_id, turn, case turn % 9 when 1 then 'no_reservation' when 2 then 'replay_unanswered' when 3 then 'order' when 4 then 'output' when 5 then 'reserved_again' end as reason from conversations where turn % 9 in (1, 2, 3, 4, 5) and {runs}"


@query(_reservation_sql("conv_id % 3 = 0"))
def query_reservations(spark, sf_dir):
    return _reservations(spark, sf_dir, "conv_id % 3 = 0")


@query(_reservation_sql("conv_id % 3 = 1"))
def rerank_reservations(spark, sf_dir):
    return _reservations(spark, sf_dir, "conv_id % 3 = 1")


@query(_reservation_sql("conv_id % 3 = 2"))
def encoding_reservations(spark, sf_dir):
    return _reservations(spark, sf_dir, "conv_id % 3 = 2")


@query(
    """with l as (select user_id, event_id, case when event_type in ('view', 'click') then 'reserve' else 'ack' end as kind from events), n as (select *, sum((kind = 'reserve')::int) over (partition by user_id order by event_id) - 1 as n, lag(kind) over (partition by user_id order by event_id) as p from l)
select user_id, event_id, reason from (select user_id, event_id, case when event_id % 97 = 5 then 'number' when kind = 'reserve' and p = 'reserve' then 'pending' when kind = 'ack' and (p = 'ack' or p is null) then 'unreserved' end as reason from n) where reason is not null"""
)
def invocation_chains(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), "reserve").otherwise("ack").alias("kind"))
    n = F.sum((F.col("kind") == "reserve").cast("int")).over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return K.invocation_violations(e.withColumn("number", n + F.when(F.col("event_id") % 97 == 5, 1).otherwise(0)), "user_id", "event_id")


@query("select doc_id, case when doc_id % 4 = 1 then 'unknown' when doc_id % 6 = 2 then 'answered' when doc_id % 5 = 3 then 'repeated' end as reason from documents where doc_id % 4 = 1 or doc_id % 6 = 2 or doc_id % 5 = 3")
def reconciliations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return K.reconciliation_violations(d.union(d.where("doc_id % 5 = 3")), d.where("doc_id % 4 <> 1"), d.where("doc_id % 6 = 2"), [], "doc_id")


@query(
    """with g as (select user_id, count(*) as n, arg_max(event_id, event_id) as d, sum(length(props)) as b, count(*) filter (event_type = 'click') as j, arg_max(event_type, event_id) as e from events group by user_id)
select user_id, reason from (select user_id, case when user_id % 9 = 1 then 'rows' when user_id % 9 = 2 then 'last_digest' when user_id % 9 = 3 then 'bytes' when user_id % 9 = 4 then 'judge_calls' when e <> 'view' then 'stop' end as reason from g) where reason is not null"""
)
def journal_seals(spark, sf_dir):
    """Seals against the log, whose last entry should be the stop (here a view)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "stop").otherwise(F.col("event_type")).alias("event"), F.col("event_id").cast("string").alias("digest"), F.length("props").alias("bytes"), (F.col("event_type") == "click").alias("judged"))
    u = F.col("user_id") % 9
    own = e.groupBy("user_id").agg(F.count("*").alias("rows"), F.max_by("digest", "event_id").alias("last_digest"), F.sum("bytes").alias("bytes"), F.count_if("judged").alias("judge_calls"))
    seals = own.withColumns({"rows": F.col("rows") + (u == 1).cast("int"), "last_digest": F.when(u == 2, "x").otherwise(F.col("last_digest")), "bytes": F.col("bytes") - (u == 3).cast("int"), "judge_calls": F.col("judge_calls") + (u == 4).cast("int")})
    return K.seal_violations(e, seals, "user_id", "event_id")


@query("select user_id, count(*) filter (event_id % 10 = 0 or event_type = 'error' or event_id % 7 = 3 or (event_type = 'view' and event_id % 4 <> 1 and event_id % 5 <> 2)) as attempts from events group by user_id")
def fetch_attempts(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "challenge").when(F.col("event_type") == "view", "fetch").otherwise("other").alias("event"), F.when(k % 10 == 0, "click").alias("browser_action"), F.when(k % 7 == 3, "r").alias("fetch_reservation"), F.when(k % 4 == 1, "a").alias("query_ack"), F.when(k % 5 == 2, "human_browser_dom").when(k % 5 == 3, "direct").alias("route"))
    return K.fetch_attempts(e, "user_id", True)


@query("select doc_id, case when doc_id % 5 = 1 then 'unknown' when doc_id % 5 = 2 then 'url' when doc_id % 5 = 3 then 'content' end as reason from documents where doc_id % 5 in (1, 2, 3)")
def retained_notices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.concat(F.lit("s"), "doc_id").alias("sha256"))
    n = d.withColumns({"url": F.when(F.col("doc_id") % 5 == 2, "x").otherwise(F.col("url")), "sha256": F.when(F.col("doc_id") % 5 == 3, "x").otherwise(F.col("sha256"))})
    return K.notice_violations(n, d.where("doc_id % 5 <> 1"), "doc_id")


@query(
    """with r as (select conv_id, turn, turn < 3 or (conv_id % 6 = 2 and turn = 4) as kept from conversations), f as (select *, min(case when not kept then turn end) over (partition by conv_id) as first from r)
select conv_id, turn, reason from (select conv_id, turn, case when kept and turn > first then 'late' when kept and conv_id % 6 = 3 and turn = 1 and exists (select 1 from r n where n.conv_id = f.conv_id and n.turn = 3 and not n.kept) then 'leans_on_new' end as reason from f) where reason is not null"""
)
def retained_boundary(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn < 3 or (conv_id % 6 = 2 and turn = 4) as retained", "turn as id", "case when conv_id % 6 = 3 and turn = 1 then 3 when turn = 2 then 0 end as leans_on")
    return K.retained_violations(r, "conv_id", "turn")


@query(
    """with d as (select user_id, event_id % 4 as ref, min(event_id) as s from events where event_type = 'signup' group by all)
select user_id, event_id, reason from (select e.user_id, e.event_id, case when d.s is null then 'undeclared' when d.s > e.event_id then 'later' when e.event_id % 9 = 4 then 'digest' end as reason from events e left join d on d.user_id = e.user_id and d.ref = e.event_id % 4 where event_type = 'purchase') where reason is not null"""
)
def reference_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "event_id % 4 as reference", "if(event_type = 'purchase' and event_id % 9 = 4, 'x', 'd') as digest")
    return K.reference_row_violations(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id", "event_id")


@query("with b as (select *, coalesce(sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as b from events) select event_id, case when b > 2 then 'not_reached' when event_type <> 'error' then 'done' when b < 2 then 'continued' else 'stopped' end as status from b")
def failed_windows(spark, sf_dir):
    return K.failed_windows(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", 2).select("event_id", "status")


_REPLAY = "select doc_id, case when doc_id % 7 = 1 then 'unfounded' when doc_id % 7 = 2 then 'missing' when doc_id % 7 = 3 then 'differs' end as reason from documents where {0} and doc_id % 7 in (1, 2, 3)"


def _replayed(rows):
    """A recomputed table (doc_id, v) against a log that claims too much, too little, and something else."""
    return K.replayed(rows.where("doc_id % 7 <> 2").withColumn("v", F.when(F.col("doc_id") % 7 == 3, "x").otherwise(F.col("v"))), rows.where("doc_id % 7 <> 1"), ["doc_id"], "v")


@query(_REPLAY.format("length(text) >= 4"))
def semantic_replay(spark, sf_dir):
    """Mentions are projected again from their proposals; a log's statuses must be theirs."""
    d = table(spark, sf_dir, "documents").where("length(text) >= 4").select(F.col("doc_id").alias("document_id"), "text", F.lit("k").alias("key"), F.substring("text", 2, 3).alias("surface"), F.lit(0).alias("occurrence"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    return _replayed(G.mentions(d, "text", 0.5).select(F.col("document_id").alias("doc_id"), F.concat_ws("|", "status", "node_id").alias("v")))


@query(_REPLAY.format("true"))
def judgment_replay(spark, sf_dir):
    """Dispositions are decided again from what each reading recorded."""
    k = F.col("doc_id")
    decision = F.when(k % 3 == 0, "accept").when(k % 3 == 1, "hold").otherwise("reject")
    x = A.disposition(decision, F.lit(None).cast("string"), k % 4, k % 2 == 0, (k % 10) / 10)
    return _replayed(table(spark, sf_dir, "documents").select("doc_id", F.to_json(x).alias("v")))


@query(_REPLAY.format("true"))
def identity_replay(spark, sf_dir):
    """Identity decisions are derived again from proposals and reviews."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    p = d.selectExpr("doc_id", "cast(null as string) as valid_from", "cast(null as string) as valid_to", "'q' as quote")
    decided, withheld = K.reviewed_decisions(p, d.selectExpr("doc_id", "if(doc_id % 2 = 0, 'supported', 'ambiguous') as verdict"), "doc_id")
    return _replayed(decided.select("doc_id", F.lit("decided").alias("v")).union(withheld.select("doc_id", F.col("reason").alias("v"))))


@query(_REPLAY.format("length(text) > 0"))
def selection_replay(spark, sf_dir):
    """The union of scored spans is found again; a log's spans must be it."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0").selectExpr("doc_id", "length(text) as n")
    s = d.selectExpr("doc_id", "n", "inline(array(struct(0L as a, least(n, 80) as b, 0.9D as c), struct(least(n - 1, 300) as a, least(n, 360) as b, 0.5D as c)))")
    spans = C.scored_spans(s, "doc_id", "a", "b", "c", "n", 2, 400, 10).groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("v"))
    return _replayed(spans.withColumnRenamed("doc", "doc_id"))


@query("with p as (select conv_id, row_number() over (partition by conv_id order by turn) as i, (conv_id * 31 + turn * 17) % 60 as size, turn from conversations) select conv_id, turn, case when conv_id % 5 = 1 and turn = 0 then 'differs' end as reason from p where conv_id % 5 = 1 and turn = 0")
def planning_replay(spark, sf_dir):
    """The greedy fill of a planning view is made again; a log that dropped an item that fits is found."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "(conv_id * 31 + turn * 17) % 60 as size")
    fill = R.greedy_fill(c, "conv_id", ["turn"], "size", 150)
    claimed = fill.withColumn("kept", F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") == 0), ~F.col("kept")).otherwise(F.col("kept")))
    return K.replayed(claimed, fill, ["conv_id", "turn"], "kept")
