"""Registered queries on records of a run, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..sources.shared import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("select user_id, arg_min(event_type, event_id) as provider, min(event_id) as event_id from events where event_id % 3 = 0 group by user_id")
def discovery_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("provider"))
    return R.first_provider(e, "user_id", "event_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).select("user_id", "provider", "event_id")


@query("with v as (select url, min(page_id) as page_id from pages where page_id % 3 <> 0 group by url) select p.page_id, case when v.page_id is null then '' when v.page_id % 2 = 0 then 'If-None-Match' else 'If-Modified-Since' end as header from pages p left join v using (url)")
def conditional_requests(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    v = p.where("page_id % 3 <> 0").groupBy("url").agg(F.min("page_id").alias("id")).select("url", F.when(F.col("id") % 2 == 0, F.lit('"e"')).alias("etag"), F.lit("Wed, 01 Jan 2020 00:00:00 GMT").alias("last_modified"))
    return R.conditional_headers(p, v, "url").select("page_id", F.coalesce(F.get("headers", F.lit(0))["name"], F.lit("")).alias("header"))


@query("select distinct on (text) doc_id, 8 as generation from (select * from documents where doc_id % 4 <> 1 order by doc_id) where text not in (select text from documents where doc_id % 4 = 1) order by text, doc_id")
def corpus_append(spark, sf_dir):
    """Texts that a corpus of every fourth document lacks; each stands under its first document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = d.where("doc_id % 4 <> 1").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    return R.corpus_append(d.where("doc_id % 4 = 1"), first, ["sha"], F.lit(True), 7).select("doc_id", "generation")


@query("select conv_id, turn, (sum(length(text) + 2) over w - 2 - length(text))::bigint as start, (sum(length(text) + 2) over w - 2)::bigint as \"end\" from conversations window w as (partition by conv_id order by turn rows unbounded preceding)")
def page_offsets(spark, sf_dir):
    return R.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start", "end")


@query("with o as (select conv_id, turn, sum(length(text) + 2) over w - 2 - length(text) as s, sum(length(text) + 2) over w - 2 as e from conversations window w as (partition by conv_id order by turn rows unbounded preceding)) select conv_id, string_agg(turn::varchar, ',' order by turn) as turns from o where s < 150 and 50 < e group by conv_id")
def cited_pages(spark, sf_dir):
    p = R.page_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.col("turn").alias("page"), "start", "end")
    spans = p.select("conv_id").distinct().select("conv_id", F.lit(50).alias("start"), F.lit(150).alias("end"))
    out = R.cited_pages(spans, p, "conv_id").select("conv_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("turns"))
    return out.where("turns <> ''")


@query("with w as (select doc_id, text, unnest(range(0, length(text), 2000)) as s from documents where length(text) > 0) select doc_id, (s // 2000)::int as \"window\", s::int as start, (s + length(substr(text, s + 1, 2000)))::int as \"end\", sha256(substr(text, s + 1, 2000)) as digest from w")
def contiguous_windows(spark, sf_dir):
    return R.contiguous_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 2000).withColumnRenamed("doc", "doc_id")


@query(
    """with recursive c as (select user_id, event_id, (event_id * 37) % 91 + 5 as size, row_number() over (partition by user_id order by -event_id) as i from events),
f as (select user_id, 0::bigint as i, null::bigint as event_id, 0::bigint as n, false as kept from (select distinct user_id from c) union all select c.user_id, c.i, c.event_id, case when f.n + size <= 400 then f.n + size else f.n end, f.n + size <= 400 from f join c on c.user_id = f.user_id and c.i = f.i + 1)
select event_id, kept from f where i > 0"""
)
def planning_fill(spark, sf_dir):
    """Each user's events, newest first, as items that must fit in one view."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (-F.col("event_id")).alias("o"), ((F.col("event_id") * 37) % 91 + 5).alias("size"))
    return R.greedy_fill(e, "user_id", ["o"], "size", 400).select("event_id", "kept")


@query("select user_id, count(*) filter (event_type = 'view') as \"view\", count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error from events group by user_id")
def state_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.state_report(e, "user_id", "event_type", ["view", "click", "error"])


@query("select doc_id, contains(text, 'the') as required_ok, instr(text, 'and') > 0 and instr(substr(text, instr(text, 'and') + 3), 'of') > 0 as ordered_ok, n_chars = 500 as pages_ok from documents")
def document_acceptance(spark, sf_dir):
    return R.acceptance(table(spark, sf_dir, "documents"), "doc_id", "text", ["the"], ["and", "of"], "n_chars", 500)


@query("select page_id, 'u:' || sha256((octet_length(encode(url)))::varchar || ':' || url || '|' || octet_length(encode(sha256(html)))::varchar || ':' || sha256(html) || '|0:|1:1') as identity from pages")
def document_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    who = R.document_identity(F.col("url"), F.sha2(F.col("html").cast("binary"), 256), F.lit(None).cast("string"), F.lit("1"))
    return p.select("page_id", F.concat(F.lit("u:"), F.sha2(who.cast("binary"), 256)).alias("identity"))


@query("select c.conv_id, c.turn, case when d.doc_id is null then 'document' when c.turn % 4 = 3 then 'encoding' else 'input' end as reason from conversations c left join documents d on d.doc_id = c.conv_id and d.doc_id % 7 <> 0 where d.doc_id is null or c.turn % 4 = 3 or c.turn % 5 = 2")
def encoding_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", "conv_id", "turn")
    p = c.select(key.alias("passage_id"), F.col("conv_id").alias("document_id"), F.col("conv_id").alias("encoding_id"), F.col("turn").alias("batch_index"), "text")
    calls = c.where("turn % 4 <> 3").select(F.col("conv_id").alias("encoding_id"), F.col("turn").alias("batch_index"), F.sha2(F.concat("text", F.when(F.col("turn") % 5 == 2, "x").otherwise("")).cast("binary"), 256).alias("input_sha256"))
    d = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("document_id"))
    out = R.encoding_checks(p, d, calls)
    return out.select(F.split("passage_id", ":")[0].cast("bigint").alias("conv_id"), F.split("passage_id", ":")[1].cast("bigint").alias("turn"), "reason")


@query("select source as doc, arg_min(substr(text, 1, 40), (case when doc_id % 3 = 0 then 0 else 1 end, doc_id)) as title from documents where trim(substr(text, 1, 40)) <> '' group by source")
def document_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", F.substring("text", 1, 40).alias("text"), F.when(F.col("doc_id") % 3 == 0, "title").otherwise("text").alias("label"))
    return R.document_titles(d, "doc", "doc_id")


@query(
    """with c as (select label % 3 as intent, label as d, vec_id, (vec_id % 10) * 50 as s, (vec_id % 10) * 50 + 80 as e, (vec_id * 7919) % 1009 as score, vec_id % 50 = 0 as req from embeddings)
select count(*) as n, sum(vec_id)::bigint as total from c"""
)
def evidence_candidates(spark, sf_dir):
    """How many candidates the evidence context sees; which are shown is tested by hand."""
    out = _context(spark, sf_dir)
    return out.agg(F.count("*").alias("n"), F.sum("vec_id").alias("total"))


def _context(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("intent"), F.col("label").alias("d"), "vec_id", ((F.col("vec_id") % 10) * 50).alias("s"), ((F.col("vec_id") % 10) * 50 + 80).alias("e"), ((F.col("vec_id") * 7919) % 1009).alias("score"), (F.col("vec_id") % 50 == 0).alias("req"))
    return R.evidence_context(e, "intent", "d", "s", "e", "score", "req", 2, 3, 600)


def evidence_context(spark, sf_dir):
    return _context(spark, sf_dir).select("vec_id", "status")


QUERIES["evidence_context"] = evidence_context
