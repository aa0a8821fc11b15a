"""Registered queries on passages, ranking, scoring and readings, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import filters as P
from ..operators import retrieval as R
from ..operators import scoring as S
from ..sources.shared import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: Words of the registered searches, by query.
TERMS = {"q1": "the heention erthwh", "q2": "einander lichkeit und", "q3": "reention thatre is"}
_TOK = r"regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_TERMS = ", ".join(f"('{k}', '{v}')" for k, v in TERMS.items())
_BM25 = rf"""
tk as materialized (select doc_id, {_TOK} as w from documents),
st as (select greatest(1, count(*)) as n, sum(len(w)) / greatest(1, count(*)) as mean from tk),
qt as (select distinct q, unnest(string_split(t, ' ')) as term from (values {_TERMS}) v(q, t)),
po as (select doc_id, len(w) as length, term, count(*) as tf from (select doc_id, w, unnest(w) as term from tk) where term in (select term from qt) group by all),
df as (select term, count(*) as df from po group by term),
sc as (select q, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from po join df using (term) join qt using (term), st group by q, doc_id),
bm as (select q, doc_id, score, row_number() over (partition by q order by round(score, 9) desc, doc_id) as rank from sc where score > 0)"""


def _searches(spark):
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("q"), F.lit(v).alias("t")) for k, v in TERMS.items()))).alias("x")).select("x.*")


@query("with c as (select doc_id, text, unnest(range(0, length(text), 1040)) as start from documents where length(text) > 0) select doc_id, (start // 1040)::int as chunk, start::int as start, substr(text, start + 1, 1200) as text from c where regexp_matches(substr(text, start + 1, 1200), '\\S')")
def passage_chunks(spark, sf_dir):
    out = R.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("doc").alias("doc_id"), "chunk", "start", "text")


@query(rf"with t as (select doc_id, unnest({_TOK}) as term from documents) select term, count(*) as n, count(distinct doc_id) as documents from t group by term")
def term_statistics(spark, sf_dir):
    t = R.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return t.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("documents"))


@query(rf"with t as (select {_TOK} as w from documents) select greatest(1, count(*)) as passages, round(sum(len(w)) / greatest(1, count(*)), 6) as mean_length from t")
def corpus_statistics(spark, sf_dir):
    return R.corpus_statistics(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("passages").cast("bigint").alias("passages"), F.round("mean_length", 6).alias("mean_length"))


def _bm25(spark, sf_dir, top):
    out = R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _searches(spark), "q", "t")
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "passage")
    return out.withColumn("rank", F.row_number().over(w)).where(f"rank <= {top}")


@query(f"with {_BM25} select q as query, doc_id, round(score, 6) as score, rank::int as rank from bm where rank <= 40")
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, 40).select("query", F.col("passage").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double))"


@query(
    f"""with qs as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
s as (select b.vec_id as query, a.vec_id, greatest(-1, least(1, {_COS})) as c from embeddings a, qs b),
r as (select *, row_number() over (partition by query order by round(c, 9) desc, vec_id) as rank from s)
select query, vec_id, round(c, 6) as cosine, rank::int as rank from r where rank <= 10"""
)
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = R.vector_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 14)
    w = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "key")
    return out.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query", F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


@query("with n as (select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as s from embeddings) select vec_id, round(v[1] / s, 6) as first, round(list_sum(list_transform(v, lambda x: abs(x / s))), 6) as size from n where s > 0")
def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", X.unit_vector(F.col("embedding")).alias("u")).select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("size"))


@query(
    f"""with {_BM25},
v as (select q, id as doc_id, row_number() over (partition by q order by id % 7, id) as vr from (select unnest(['q1', 'q2', 'q3']) as q), (select unnest(range(0, 200, 5)) as id)),
f as (select coalesce(v.q, l.q) as q, coalesce(v.doc_id, l.doc_id) as doc_id, vr, l.rank as lr, coalesce(l.score, 0) as ls, coalesce(1.0 / (60 + vr), 0) + coalesce(2.0 / (60 + l.rank), 0) as fused from v full join (select * from bm where rank <= 40) l on l.q = v.q and l.doc_id = v.doc_id)
select q as query, doc_id, coalesce(vr, 0)::int as vector_rank, coalesce(lr, 0)::int as lexical_rank, round(fused, 9) as fused, (row_number() over (partition by q order by round(fused, 12) desc, doc_id))::int as rank from f"""
)
def hybrid_rrf(spark, sf_dir):
    """Lexical ranks fused with a given ranking of ids."""
    ids = spark.range(0, 200, 5).select(F.explode(F.array(*map(F.lit, TERMS))).alias("query"), F.col("id").alias("doc_id"))
    vec = ids.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("doc_id") % 7, "doc_id")))
    lex = _bm25(spark, sf_dir, 40).select("query", F.col("passage").alias("doc_id"), "score", "rank")
    out = R.fuse(vec, lex, ["query", "doc_id"], 1.0, 2.0)
    w = W.partitionBy("query").orderBy(F.desc(F.round("fused", 12)), "doc_id")
    return out.select("query", "doc_id", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.round("fused", 9).alias("fused"), F.row_number().over(w).alias("rank"))


_RR = "(vec_id * 7919) % 1009 / 1009.0"


@query(
    f"""with recursive c as (select label % 4 as q, label, vec_id, embedding[1]::double as cosine, {_RR} as logit, vec_id % 5 <> 0 as lang from embeddings),
o as (select *, row_number() over (partition by q order by logit desc, vec_id) as i from c),
f as (select q, 0::bigint as i, null::bigint as vec_id, []::int[] as docs, ''::varchar as reason from (select distinct q from o)
 union all select o.q, o.i, o.vec_id, case when r.reason = 'selected' then list_append(f.docs, o.label) else f.docs end, r.reason
 from f join o on o.q = f.q and o.i = f.i + 1, lateral (select case when o.cosine < -0.1 then 'minimum_cosine' when not o.lang then 'language' when len(list_filter(f.docs, lambda d: d = o.label)) >= 3 then 'passages_per_document'
   when not list_contains(f.docs, o.label) and len(list_distinct(f.docs)) >= 2 then 'document_limit' when len(f.docs) >= 5 then 'top_k' else 'selected' end as reason) r)
select q::int as query, vec_id, reason from f where i > 0"""
)
def rerank_selection(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("query"), "label", "vec_id", F.col("embedding")[0].cast("double").alias("cosine"), (((F.col("vec_id") * 7919) % 1009) / 1009.0).alias("logit"))
    out = R.rerank_selection(e, "query", "label", "vec_id", "cosine", "logit", F.col("vec_id") % 5 != 0, -0.1, 3, 2, 5)
    return out.select(F.col("query").cast("int").alias("query"), "vec_id", "reason")


@query(
    rf"""with {_BM25}, h as (select q, doc_id, rank, 'https://' || source || '.example.org/' as url, source from bm join documents using (doc_id) where rank <= 30),
k as (select *, source <> 'src1' as web, rank <= 25 as close from h), n as (select *, row_number() over (partition by q, url, (web and close) order by rank) as c from k),
s as (select *, sum(case when web and close and c = 1 then 1 else 0 end) over (partition by q order by rank rows unbounded preceding) as leads from n)
select q as query, doc_id, case when not close then 'minimum_cosine' when not web then 'non_http_source' when c > 1 then 'same_source' when leads > 8 then 'result_limit' else 'lead' end as reason from s"""
)
def search_leads(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 30).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage"), "source"), "passage")
    hits = hits.select("query", "passage", "rank", "source", F.concat(F.lit("https://"), "source", F.lit(".example.org/")).alias("url"), F.when(F.col("rank") <= 25, 1.0).otherwise(0.0).alias("c"))
    return R.search_leads(hits, "query", "url", "rank", "c", 0.5, F.col("source") != "src1", 8).select("query", F.col("passage").alias("doc_id"), "reason")


@query(
    """with w as (select doc_id, text, unnest(range(0, length(text), 350)) as start from documents where length(text) > 0),
t as (select doc_id, start, substr(text, start + 1, 400) as x from w), m as (select *, len(list_filter(['the', 'heention', 'und', 'that'], lambda g: contains(lower(x), g))) as matched from t where regexp_matches(x, '\\S')),
r as (select *, row_number() over (partition by doc_id order by matched desc, start) as rn, greatest(0, count(*) over (partition by doc_id) - 3) as omitted from m)
select doc_id, start::int as start, (start + length(x))::int as "end", matched::int as matched, omitted from r where rn <= 3"""
)
def goal_windows(spark, sf_dir):
    out = S.goal_windows(table(spark, sf_dir, "documents"), "doc_id", "text", "the heention und that", 400, 50, 3)
    return out.select(F.col("doc").alias("doc_id"), "start", "end", "matched", F.col("omitted").cast("bigint").alias("omitted"))


def scored_spans(spark, sf_dir):
    """Windows of a goal, padded and united within the room that a reader has."""
    docs = table(spark, sf_dir, "documents")
    w = S.goal_windows(docs, "doc_id", "text", "the heention und that", 400, 50, 6).join(docs.select(F.col("doc_id").alias("doc"), F.length("text").alias("length")), "doc")
    out = S.scored_spans(w.withColumn("score", F.col("matched").cast("double")), "doc", "start", "end", "score", "length", 3, 1500, 100)
    return out.select(F.col("doc").alias("doc_id"), "start", "end", "omitted")


QUERIES["scored_spans"] = scored_spans


@query(
    """with s as (select doc_id, length(text) as n, unnest([0, 1, 2, 3]) as k from documents where length(text) >= 2000), c as (select *, k * 500 + 100 as a, k * 500 + 200 as b, (doc_id * 7 + k * 3) % 11 as score from s),
r as (select *, row_number() over (partition by doc_id order by score desc, a) as i from c) select doc_id, a - 50 as start, b + 50 as "end" from r where i <= 3"""
)
def padded_spans(spark, sf_dir):
    """Spans that lie too far apart to touch: the three best, padded on both sides."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 2000")
    s = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).selectExpr("doc_id", "n", "k * 500 + 100 as a", "k * 500 + 200 as b", "(doc_id * 7 + k * 3) % 11 as score")
    return S.scored_spans(s, "doc_id", "a", "b", "score", "n", 3, 10_000, 50, 400).select(F.col("doc").alias("doc_id"), "start", "end")


@query(
    """with w as (select doc_id, unnest(range(0, length(text), 350)) as s, length(text) as n from documents where length(text) > 0), k as (select doc_id, s, least(n, s + 400) as e from w),
c as (select doc_id, greatest(0, e - greatest(s, coalesce(max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding), 0))) as c from k) select doc_id, sum(c)::bigint as covered from c group by doc_id"""
)
def covered_characters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    s = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(350))).alias("s")).select("doc_id", "s", F.least(F.col("n"), F.col("s") + 400).alias("e"))
    return S.covered(s, "doc_id", "s", "e").select(F.col("doc").alias("doc_id"), "covered")


@query(
    r"""with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">', 1)) as h, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)">', 1), 1) as ord from pages),
s as (select page_id, h, ord, case when contains(lower(h), 'the') or contains(lower(h), 'lich') then 1.0 else 0.0 end as kw, (ord % 5) / 5.0 as c from l), k as (select *, round(0.7 * kw + 0.3 * c, 6) as score from s),
r as (select *, row_number() over (partition by page_id order by score desc, ord) as rn from k) select page_id, h as link, ord::int as ordinal, score from r where rn <= 10 and score >= 0.5"""
)
def link_scores(spark, sf_dir):
    """The ten best links of each page by keyword and a given cosine, and of them those that score enough."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("o", "link")).withColumn("ordinal", F.col("o") + 1)
    kw = X.keyword_score(F.lit("the lich"), F.lit(""), F.col("link"))
    scored = S.link_scores(links, kw, (F.col("ordinal") % 5) / 5.0, 0.7).withColumn("score", F.round("score", 6))
    return P.ranked_links(scored, "page_id", "ordinal", "score", 10, 0.5).select("page_id", "link", "ordinal", "score")


_DISP = "case when quality = 1 and toxic = 0 then 'accept' when toxic = 1 then 'reject' else 'hold' end"


@query(
    f"""with j as (select doc_id, {_DISP} as d, case when quality is null then null when quality = 1 then 'direct' end as rel, doc_id % 3 as omitted, doc_id % 2 = 0 as second, (doc_id % 10) / 10.0 as c from labels)
select doc_id, case when d <> 'accept' and omitted > 0 and not second then 'look_again' when d = 'accept' or (d = 'hold' and c >= 0.8) then 'keep' else 'hold' end as action,
 coalesce(rel, case when d = 'reject' then 'unrelated' when d = 'accept' then 'supporting' else 'background' end) as grade,
 case when d <> 'accept' and omitted > 0 and not second then 'omitted_text' when d = 'accept' then 'accepted' when d = 'hold' and c >= 0.8 then 'cosine_floor' when d = 'reject' then 'rejected' else 'held' end as reason from j"""
)
def reading_disposition(spark, sf_dir):
    d = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accept").when(F.col("toxic") == 1, "reject").otherwise("hold")
    out = table(spark, sf_dir, "labels").select("doc_id", P.disposition(d, F.when(F.col("quality") == 1, "direct"), F.col("doc_id") % 3, F.col("doc_id") % 2 == 0, (F.col("doc_id") % 10) / 10.0).alias("x"))
    return out.select("doc_id", "x.*")


@query("select lang, case when toxic = 1 then 'unrelated' when quality = 1 then 'supporting' else 'background' end as grade, count(*) as pages, count(distinct source) as sources from labels join documents using (doc_id) group by all")
def grade_histogram(spark, sf_dir):
    g = P.grade(F.lit(None).cast("string"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("hold"))
    out = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return out.groupBy("lang", g.alias("grade")).agg(F.count("*").alias("pages"), F.count_distinct("source").alias("sources"))


@query("with r as (select doc_id, case when toxic = 1 then 'unrelated' when quality = 1 then 'direct' else 'background' end as grade from labels) select doc_id, grade from r where grade <> 'unrelated' order by case grade when 'direct' then 0 else 2 end, doc_id limit 32")
def answer_order(spark, sf_dir):
    g = F.when(F.col("toxic") == 1, "unrelated").when(F.col("quality") == 1, "direct").otherwise("background")
    return P.answer_order(table(spark, sf_dir, "labels").select("doc_id", g.alias("grade")), "grade", "doc_id", 32)


@query("select conv_id, turn, case when length(text) <= 60 then text else rtrim(case when substr(text, 61, 1) in (' ', chr(9), chr(10)) or length(regexp_extract(substr(text, 1, 60), '(?s)^(.*)[ \\t\\n]', 1)) = 0 then substr(text, 1, 60) else regexp_extract(substr(text, 1, 60), '(?s)^(.*)[ \\t\\n]', 1) end, ' ') end as query from conversations")
def query_truncation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncated_query(F.col("text"), 60).alias("query"))


@query("with q as (select doc_id, substr(text, 11, 30) as quote, 10 as pos from documents where length(text) >= 60), c as (select doc_id + (doc_id % 4 = 3)::int as target, quote, pos from q) select target as doc_id, quote, coalesce(substr(d.text, pos + 1, length(quote)) = quote, false) as exact, d.doc_id is not null as known from c left join documents d on d.doc_id = c.target")
def citation_match(spark, sf_dir):
    """Quotes and their places against the text of the document that they cite; some cite the next document on purpose."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cites = docs.where(F.length("text") >= 60).select((F.col("doc_id") + F.when(F.col("doc_id") % 4 == 3, 1).otherwise(0)).alias("target"), F.substring("text", 11, 30).alias("quote"), F.lit(10).alias("at"))
    got = cites.join(docs, F.col("target") == F.col("doc_id"), "left")
    return got.select(F.col("target").alias("doc_id"), "quote", F.coalesce(F.substring("text", F.col("at") + 1, F.length("quote")) == F.col("quote"), F.lit(False)).alias("exact"), F.col("doc_id").isNotNull().alias("known"))


@query(r"select page_id, regexp_matches(lower(html), 'captcha|cf-challenge|verify you are human') as challenge, coalesce(regexp_matches(lower(html), 'enable javascript|javascript is required|requires javascript'), false) as script from pages")
def page_barriers(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", (P.barrier(F.col("html"), F.lit("text/html")) == "challenge").alias("c"), P.needs_script(F.col("html")).alias("script")).select("page_id", F.coalesce("c", F.lit(False)).alias("challenge"), "script")


@query(
    r"""with r(host, prefix, allow) as (values ('tionsh.example.net', '/', false), ('tionsh.example.net', '/en/', true), ('blog.tionble.example.com', '/en/7', false)),
p as (select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, coalesce((select arg_max(allow, length(prefix)) from r where r.host = p.host and starts_with(p.path, prefix)), true) as allowed from p"""
)
def robots_permission(spark, sf_dir):
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for h, p, a in (("tionsh.example.net", "/", False), ("tionsh.example.net", "/en/", True), ("blog.tionble.example.com", "/en/7", False))))))
    p = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("h"), U.path(F.col("url")).alias("p"))
    return P.robots_allow(p, "p", "h", rules).select("page_id", "allowed")
