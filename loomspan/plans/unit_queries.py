"""Registered queries on single rules: fetching, urls, admission, log pairs, budgets and text pieces, each with DuckDB SQL.

The tables hold no runs of a collector, so their rows stand for its records: keys and fields are derived by arithmetic, so
that every branch of a rule has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup as D
from ..operators import filters as A
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import planning as P
from ..operators import records as R
from ..operators import retrieval as S
from ..operators import scoring as C
from ..sources import feeds, files, html
from ..sources.shared import shared_dir, table
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _one_of(key: str, *values):
    """A value by the remainder of a key."""
    out = F.when(F.col(key) % len(values) == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(key) % len(values) == i, F.lit(v))
    return out


def _sql_of(key: str, *values) -> str:
    lit = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when {key} % {len(values)} = {i} then {lit(v)}" for i, v in enumerate(values)) + " end"


_STATUS = (200, 301, 404, 500, None, 503, 429)


@query(
    f"""with r as (select page_id, {_sql_of('page_id', *_STATUS)} as status, page_id % 3 <> 0 as mime_ok, page_id % 5 = 0 as script, page_id % 11 <> 0 as scope_ok, page_id % 13 <> 0 as robots_ok from pages)
select page_id, case when not scope_ok then 'out_of_scope' when not robots_ok then 'robots' when status between 400 and 499 then 'stop' when status >= 500 or status is null then 'next_route' when not mime_ok then 'refuse' when script then 'render' else 'read' end as outcome,
coalesce(status in (408, 425, 429, 500, 502, 503, 504), false) as retry from r"""
)
def fetch_outcomes(spark, sf_dir):
    k = F.col("page_id")
    status = _one_of("page_id", *_STATUS)
    out = A.fetch_outcome(status, k % 3 != 0, k % 5 == 0, k % 11 != 0, k % 13 != 0)
    return table(spark, sf_dir, "pages").select("page_id", out.alias("outcome"), F.coalesce(A.retryable(status), F.lit(False)).alias("retry"))


def _headers(*pairs):
    return F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs))


@query("select page_id, case when page_id % 4 = 0 then 'https://r.example.org/p' || page_id when page_id % 4 = 3 then regexp_extract(url, '^[a-z]+://[^/?#]+') || '/moved/' || page_id end as target from pages where starts_with(url, 'http')")
def redirect_targets(spark, sf_dir):
    """One absolute target, two headers, none, or one relative target."""
    p = table(spark, sf_dir, "pages").where("startswith(url, 'http')")
    away, near = F.concat(F.lit("https://r.example.org/p"), "page_id", F.lit("#f")), F.concat(F.lit("/moved/"), "page_id")
    h = F.when(F.col("page_id") % 4 == 0, _headers(("Location", away), ("Server", F.lit("x")))).when(F.col("page_id") % 4 == 1, _headers(("location", away), ("Location", near))).when(F.col("page_id") % 4 == 2, _headers(("Server", F.lit("x")))).otherwise(_headers(("LOCATION", near)))
    return p.select("page_id", U.redirect_target(F.col("url"), h).alias("target"))


_CACHE, _VARY = ("no-store", "max-age=1, No-Store", "max-age=60", "private"), ("*", "Accept", "Accept, *")


@query(f"select page_id, page_id % 4 >= 2 and page_id % 3 = 1 as cacheable, case when page_id % 2 = 0 then 'etag,vary' else 'vary' end as kept from pages")
def response_headers(spark, sf_dir):
    h = F.concat(_headers(("Cache-Control", _one_of("page_id", *_CACHE)), ("Vary", _one_of("page_id", *_VARY)), ("Set-Cookie", F.lit("a=b"))), F.when(F.col("page_id") % 2 == 0, _headers(("ETag", F.lit('"1"')))).otherwise(F.expr("cast(array() as array<struct<name:string,value:string>>)")))
    kept = F.array_join(F.sort_array(F.transform(U.kept_headers(h, ("etag", "vary", "last-modified")), lambda x: F.lower(x["name"]))), ",")
    return table(spark, sf_dir, "pages").select("page_id", U.cacheable(h).alias("cacheable"), kept.alias("kept"))


#: A public address whose name carries its checksum, and the same with one letter changed.
_ONION = "duckduckgogg42xjoc72x3sjasowoarfbgcmvfimaftt6twagswzczad.onion"
_HOSTS = (_ONION, "e" + _ONION[1:], "example.com", "www." + _ONION, "archive.example.org")


@query(f"with h as (select page_id, {_sql_of('page_id', *_HOSTS)} as host from pages) select page_id, host, host in ('{_HOSTS[0]}', '{_HOSTS[3]}') as valid, case when ends_with(host, '.onion') then 'tor' when host = 'example.com' then 'proxy' else 'direct' end as route from h where ends_with(host, '.onion') or page_id % 2 = 0")
def host_routes(spark, sf_dir):
    """Hosts of the configured kinds of domain (for odd pages onion names only), whether an onion name is valid, and the route."""
    h = table(spark, sf_dir, "pages").select("page_id", _one_of("page_id", *_HOSTS).alias("host"))
    kinds = spark.createDataFrame([("onion",), ("open_web",)], "kind string")
    kept = A.domains(h.where("page_id % 2 = 0"), "host", kinds).union(A.domains(h.where("page_id % 2 = 1"), "host", kinds.where("kind = 'onion'")))
    return kept.select("page_id", "host", U.onion_host("host").alias("valid"), U.route(F.col("host"), {"example.com": "proxy"}, "direct").alias("route"))


_TYPES = ("application/pdf", "application/octet-stream", None, "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/html", "Application/PDF; charset=x")


@query(f"with m as (select page_id, {_sql_of('page_id', *_TYPES)} as t, page_id % 4 = 0 as pdf from pages) select page_id, case when lower(trim(split_part(t, ';', 1))) = 'application/pdf' or (pdf and (t is null or t = 'application/octet-stream')) then 'pdf' when t = '{_TYPES[3]}' then 'docx' end as kind from m")
def media_kinds(spark, sf_dir):
    content = F.when(F.col("page_id") % 4 == 0, F.lit(b"%PDF-1.7 x")).otherwise(F.lit(b"PK\x03\x04 x"))
    return table(spark, sf_dir, "pages").select("page_id", files.media(_one_of("page_id", *_TYPES), content).alias("kind"))


@query(
    """with r as (select conv_id, conv_id * 100 + turn as seq, (conv_id * 100 + turn) * 37 % 100 as score, turn % 4 as hops, turn % 5 <> 4 as scope_ok, (conv_id * 100 + turn) % 11 = 0 as seen from conversations),
e as (select *, case when hops > 2 then 'hop_limit' when score < 30 then 'below_score' when seen then 'already_seen' when not scope_ok then 'out_of_scope' end as early from r),
p as (select *, sum((early is null)::int) over (partition by conv_id order by seq) as p from e),
q as (select seq from p where early is null and p <= 2 order by seq limit 100)
select p.seq, coalesce(early, case when q.seq is null then 'budget_limit' else 'queued' end) as decision from p left join q using (seq)"""
)
def reference_admission(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("seq")).selectExpr("conv_id", "seq", "seq * 37 % 100 as score", "turn % 4 as hops", "turn")
    return A.references(r, "conv_id", "seq", "score", "hops", F.col("turn") % 5 != 4, F.col("seq") % 11 == 0, 2, 30, 2, 100).select("seq", "decision")


def _links(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_id * 37 % 100 as score", "event_id % 50 as target", "event_type")


@query("select event_id from (select event_id, score, target, row_number() over (partition by user_id order by score desc, event_id) as r from (select user_id, event_id, event_id * 37 % 100 as score, event_id % 50 as target from events)) where r <= 10 and score >= 50 and target not in (select p_partkey from part where p_partkey % 7 = 0)")
def admitted_links(spark, sf_dir):
    """Ten links of a page by rank, less weak and visited ones, which are not filled up."""
    seen = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("target"))
    return A.ranked_links(_links(spark, sf_dir), "user_id", "event_id", "score", 10, 50, seen).select("event_id")


@query("select event_id, k from (select event_id, k, row_number() over (partition by user_id order by k desc, event_id) as r from (select user_id, event_id, case when contains(event_type, 'click') or contains(event_type, 'purch') then 1.0 else 0.0 end::double as k from events)) where r <= 5")
def keyword_links(spark, sf_dir):
    """The first five links of each page after those that a word of the goal is in."""
    scored = _links(spark, sf_dir).withColumn("k", T.keyword_score(F.lit("Click PURCH"), F.lit("https://x.example/"), F.col("event_type")))
    return P.top_per_parent(scored, "user_id", "k", "event_id", 5).select("event_id", "k")


@query("select distinct user_id, event_id % 50 as target from events where event_type = 'click' and event_id % 50 >= 5 and (user_id, event_id % 50) in (select (user_id, event_id % 50) from events where event_type = 'purchase')")
def followed_leads(spark, sf_dir):
    e = _links(spark, sf_dir)
    leads = e.select("user_id", "target", F.when(F.col("event_type") == "click", "link").otherwise("name").alias("kind"))
    return R.followed_leads(leads, e.where("event_type = 'purchase'"), spark.range(5).select(F.col("id").alias("target")), "user_id", "target").select("user_id", "target")


@query("with v as (select user_id, event_id, event_id % 50 as target from events), o as (select distinct target from v where target % 3 = 0) select event_id from (select event_id, row_number() over (partition by user_id order by event_id * 37 % 100 desc, event_id) as r from v where target in (select target from o)) where r <= 3")
def reference_links(spark, sf_dir):
    """The three best links of each page among observed reference targets."""
    e = _links(spark, sf_dir)
    seen = e.where("target % 3 = 0").select("target").distinct()
    return P.top_per_parent(e.join(seen, "target", "left_semi"), "user_id", "score", "event_id", 3).select("event_id")


@query("select page_id, (contains(lower(url), 'fr') or contains(lower(url), 'page')) and not contains(lower(url), 'de') and (page_id % 5 = 0 or page_id * 13 % 400 >= 100) and page_id * 7 % 300 >= 80 as admitted from pages where url is not null")
def image_admission(spark, sf_dir):
    i = table(spark, sf_dir, "pages").where("url is not null").select("page_id", "url", F.lit(None).cast("string").alias("caption"), F.lit("").alias("attributes"), F.when(F.col("page_id") % 5 != 0, F.col("page_id") * 13 % 400).alias("width"), (F.col("page_id") * 7 % 300).alias("height"))
    return html.image_candidates(i, ["FR", "page"], 100, 80, ["de"]).select("page_id", "admitted")


@query(
    """with f as (select page_id, case when page_id % 3 = 0 then 'Chart of sales' else 'a photo' end as caption, page_id % 4 as n, page_id % 100 as l, page_id % 2 = 0 as flip from pages)
select page_id, case when caption = 'a photo' then 'caption' when n <> 1 then 'regions' else 'admitted' end as status, case when caption <> 'a photo' and n = 1 then round(l / 1000.0, 6) end as "left", case when caption <> 'a photo' and n = 1 then round(case when flip then (800 - 500) / 800.0 else 100 / 800.0 end, 6) end as top from f"""
)
def figure_admission(spark, sf_dir):
    """Figures whose caption names a chart and that have one region, which is turned to the top left."""
    k = F.col("page_id")
    box = F.struct(F.lit(1).alias("page"), (k % 100).cast("double").alias("left"), F.when(k % 2 == 0, 500.0).otherwise(100.0).alias("top"), F.lit(300.0).alias("right"), F.when(k % 2 == 0, 100.0).otherwise(500.0).alias("bottom"), F.when(k % 2 == 0, "BOTTOMLEFT").otherwise("TOPLEFT").alias("origin"))
    f = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, "Chart of sales").otherwise("a photo").alias("caption"), F.array_repeat(box, (k % 4).cast("int")).alias("regions"), F.lit(1000.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return files.figure_boxes(f, ["chart"]).select("page_id", "status", F.round("box.left", 6).alias("left"), F.round("box.top", 6).alias("top"))


@query(
    """with r as (select conv_id, turn, case when turn % 7 = 6 then 'ambiguous' else 'supported' end as verdict, 60 + (conv_id * 7 + turn * 3) % 40 as c from conversations where (conv_id + turn) % 9 <> 8),
a as (select conv_id, count(*) as claims from conversations group by conv_id), g as (select conv_id, count(*) as n, count(distinct turn) as k, min(turn) as lo, max(turn) as hi, bool_and(verdict = 'supported') as ok, min(c) as c from r group by conv_id),
v as (select a.conv_id, case when g.conv_id is null or not (n = claims and k = claims and lo = 0 and hi = claims - 1) then 'coverage' when not ok then 'unsupported' when c < 70 then 'confidence' end as reason from a left join g using (conv_id))
select conv_id, reason from v where reason is not null"""
)
def answer_acceptance(spark, sf_dir):
    """Conversations as answers and their turns as claims with reviews, some of which are missing or unsure."""
    c = table(spark, sf_dir, "conversations")
    r = c.where("(conv_id + turn) % 9 <> 8").select("conv_id", F.col("turn").alias("claim"), F.when(F.col("turn") % 7 == 6, "ambiguous").otherwise("supported").alias("verdict"), (60 + (F.col("conv_id") * 7 + F.col("turn") * 3) % 40).alias("confidence"))
    return P.answer_violations(c.groupBy("conv_id").agg(F.count("*").alias("claims")), r, "conv_id", "claims", 70)


@query("select user_id, case when bool_or(event_type = 'error') then 'unsupported' when bool_or(event_type = 'signup') then 'ambiguous' else 'supported' end as verdict from events group by user_id")
def combined_verdicts(spark, sf_dir):
    v = F.when(F.col("event_type") == "error", "unsupported").when(F.col("event_type") == "signup", "ambiguous").otherwise("supported")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(v).alias("v")).select("user_id", A.worst_verdict(F.col("v")).alias("verdict"))


_AFTER = ("120", "Wed, 03 Jan 2024 00:00:00 GMT", "soon", "-5", None)


@query("select event_id, case when event_id % 5 = 0 then 120.0 when event_id % 5 = 1 then greatest(0, 1704240000 - (1704153600 + event_id * 20))::double end as wait from events")
def retry_waits(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(1704153600) + F.col("event_id") * 20)
    return table(spark, sf_dir, "events").select("event_id", T.retry_after(_one_of("event_id", *_AFTER), now).alias("wait"))


@query("select range::int as attempt, least(30.0, power(2, range))::double as wait from range(9)")
def retry_schedule(spark, sf_dir):
    """Waits of 1, 2, 4, 8, 16 and then 30 seconds while their sum stays within 180."""
    waits = T.retry_schedule()
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, waits))).alias("attempt", "wait"))


@query("select conv_id, turn, 1 as ordinal, 'w' || turn as text, round((turn * 10) / 640.0, 6) as \"left\", round((turn * 10 + 20) / 640.0, 6) as \"right\" from conversations where conv_id % 100 >= 40")
def recognised_words(spark, sf_dir):
    """Word rows of a recogniser's table: a line row, then one word, kept if it is sure enough."""
    row = lambda level, conf: F.concat_ws("\t", F.lit(level), *(F.lit(1) for _ in range(5)), F.col("turn") * 10, F.lit(5), F.lit(20), F.lit(10), conf, F.concat(F.lit("w"), "turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("k"), F.concat_ws("\n", row(4, F.lit("99")), row(5, (F.col("conv_id") % 100).cast("string"))).alias("tsv"), F.lit(640).alias("w"), F.lit(480).alias("h"))
    return files.word_boxes(c, "k", "tsv", "w", "h", 40).select("k.conv_id", "k.turn", "ordinal", "text", "left", "right")


@query("select event_id, case when event_type = 'error' then 'unjudged' else 'direct' end as grade, case when event_type = 'error' then 'keep' else 'hold' end as action, case when event_type = 'error' then 'judge_timeout' else 'held' end as reason from events")
def unjudged_readings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit("direct").alias("grade"), F.lit("hold").alias("action"), F.lit("held").alias("reason"), F.when(F.col("event_type") == "error", "judge_timeout").alias("refusal"))
    return R.unjudged(e, "refusal").drop("refusal")


@query("select distinct e.event_id from events e where event_type = 'view' and exists (select 1 from events f where f.event_type = 'error' and f.user_id = e.user_id and f.event_id < e.event_id)")
def revalidations(spark, sf_dir):
    """Uses of a kept page that an earlier answer of 'not modified' on the same address allows."""
    e = table(spark, sf_dir, "events")
    return L.between(e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'error'"), "user_id", "event_id", "event_id").select("event_id")


@query(
    """with r as (select user_id, count(*) filter (event_type = 'view') as fetches, count(*) filter (event_type = 'click') as searches, sum(length(props))::bigint as bytes from events group by user_id),
c as (select user_id, fetches + (user_id % 5 = 0)::int as fetches, searches, bytes - (user_id % 7 = 0)::int as bytes, greatest(0, fetches - searches) as page_fetches from r)
select user_id, field, counted::double as counted, claimed::double as claimed from (select r.user_id, unnest(['fetches', 'searches', 'bytes', 'page_fetches']) as field, unnest([r.fetches, r.searches, r.bytes, greatest(0, r.fetches - r.searches)]) as counted, unnest([c.fetches, c.searches, c.bytes, c.page_fetches]) as claimed from r join c using (user_id)) where counted <> claimed"""
)
def spend_restoration(spark, sf_dir):
    """Receipts that some users claim wrongly, against what their log adds up to."""
    e = table(spark, sf_dir, "events")
    own = L.receipt(e, ["user_id"], {"fetches": F.col("event_type") == "view", "searches": F.col("event_type") == "click"}, {"bytes": F.length("props")})
    told = own.withColumns({"fetches": F.col("fetches") + (F.col("user_id") % 5 == 0).cast("int"), "bytes": F.col("bytes") - (F.col("user_id") % 7 == 0).cast("int")})
    return L.receipt_differences(own, told, ["user_id"])


@query("select source, count(*) as new_documents from documents where doc_id % 3 <> 0 and text not in (select text from documents where doc_id % 3 = 0 and text is not null) group by source")
def new_documents(spark, sf_dir):
    """Documents of a round whose text no earlier round had, by source."""
    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return P.new_rows(d.where("doc_id % 3 <> 0 and text is not null"), d.where("doc_id % 3 = 0"), ["sha"]).groupBy("source").agg(F.count("*").alias("new_documents"))


@query(
    """with m as (select w.vec_id as key, r.vec_id as reference, greatest(-1, least(1, list_dot_product(w.embedding::double[], r.embedding::double[]))) as c from embeddings w, embeddings r where r.vec_id % 100 = 7),
b as (select *, row_number() over (partition by key order by c desc, reference) as n from m) select key, reference, round(c, 6) as cosine from b where n = 1"""
)
def best_references(spark, sf_dir):
    """The reference vector that is closest to each window."""
    e = table(spark, sf_dir, "embeddings")
    return C.window_cosines(e, "vec_id", "embedding", e.where("vec_id % 100 = 7"), "vec_id", "embedding").select("key", "reference", F.round("cosine", 6).alias("cosine"))


@query(
    """with f as (select conv_id, conv_id * 100 + turn as id, (turn * 13) % 60 as s, (turn * 13) % 60 + (conv_id + turn) % 25 as e from conversations), k as (select distinct conv_id, 10 as s, 40 as e from conversations),
n as (select f.*, row_number() over (partition by conv_id, s, e order by id) as n from f)
select id, case when n.s < 0 or n.e > 70 or n.s >= n.e then 'outside_text' when n > 1 then 'repeated' when n.s >= 10 and n.e <= 40 then 'already_covered' end as reason from n"""
)
def coverage_findings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "conv_id * 100 + turn as finding_id", "(turn * 13) % 60 as start", "(turn * 13) % 60 + (conv_id + turn) % 25 as end", "70 as chars")
    known = c.select("conv_id").distinct().select("conv_id", F.lit(10).alias("start"), F.lit(40).alias("end"))
    return R.coverage_findings(c, known, "conv_id").select(F.col("finding_id").alias("id"), "reason")


@query("with a as (select event_id % 500 as id, event_type as v, event_id as seq from events) select id, arg_max(v, seq) as value, min(seq) as position from a group by id")
def originals_union(spark, sf_dir):
    """Documents by identity: the last one's value at the first one's place."""
    a = table(spark, sf_dir, "events").selectExpr("event_id % 500 as id", "event_type as value", "event_id as seq")
    first = P.distinct_in_order(a, "id", "seq").select("id", F.col("seq").alias("position"))
    return D.current_revisions(a, "id", "seq").select("id", "value").join(first, "id")


@query("select distinct doc_id, case when doc_id % 3 = 1 then 'new' else 'conflict' end as what from documents where doc_id % 3 = 1 or (doc_id % 3 = 0 and doc_id % 2 = 0)")
def batch_append(spark, sf_dir):
    """A batch against a graph: every third document is new, of the others some repeat and some differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("v"))
    new, clash = L.append_batch(d.where("doc_id % 3 <> 1"), d.where("doc_id % 3 <> 2").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "other").otherwise(F.col("v")).alias("v")), "doc_id")
    return new.select("doc_id", F.lit("new").alias("what")).union(clash.select("doc_id", F.lit("conflict").alias("what")))


_PLACE = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(
    f"""select page_id, regexp_replace(url, '#.*$', '') as reference, regexp_extract(url, '^[a-z]+://') || lower({_PLACE}) as origin, starts_with(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/fr/') or regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '/fr' as under,
regexp_extract(url, '^[a-z]+://') || lower({_PLACE}) || '/i/' || page_id || '.png' as image from pages where regexp_matches(url, '^https?://[a-z0-9.-]+(/|$)')"""
)
def url_properties(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[a-z0-9.-]+(/|$)"))
    u = F.col("url")
    return p.select("page_id", U.reference_url(u).alias("reference"), U.origin(u).alias("origin"), U.under_path(U.path(u), F.lit("/fr/")).alias("under"), U.image_url(u, F.concat(F.lit(" /i/"), "page_id", F.lit(".png#x "))).alias("image"))


_PATHS = ("/a/b", "/a%2Fb", "/a/../b", "/a/%2e%2e/b", "/a%255cb", "/a\\b", "/a.b/.c", "/a/.", "/%zz")
_IDS = ("run-1", "", "-x", "A.b_c", "a b", "r" * 128, "r" * 129, "é")


@query(f"select page_id, page_id % 9 in (0, 6) as safe, page_id % 8 in (0, 3, 5) as run_id_ok, {_sql_of('page_id', 'utf-8', 'iso-8859-1', 'utf-8', 'windows-1252')} as charset from pages")
def safe_names(spark, sf_dir):
    kinds = ("text/html", "text/html; Charset=ISO-8859-1", None, "text/html;charset = \"windows-1252\"; x")
    out = T.charset(F.coalesce(_one_of("page_id", *kinds), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", U.safe_path(_one_of("page_id", *_PATHS)).alias("safe"), T.safe_run_id(_one_of("page_id", *_IDS)).alias("run_id_ok"), out.alias("charset"))


_DATES = ("2020-01-05", None, "2020-1-5", "2020-02-30", "2021-07-01")


@query(
    f"""with d as (select event_id, {_sql_of('event_id', *_DATES)} as a, {_sql_of('(event_id // 5)', '2020-12-31', None, 'x', '2019-01-01')} as b from events),
p as (select *, case when a in ('2020-01-05', '2021-07-01') then a when a is null then '0001-01-01' end as lo, case when b in ('2020-12-31', '2019-01-01') then b when b is null then '9999-12-31' end as hi from d)
select event_id, case when lo <= hi then lo end as low, case when lo <= hi then hi end as high, a is null or b is null as unknown from p"""
)
def date_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 5).alias("q"))
    b = T.date_bounds(_one_of("event_id", *_DATES), _one_of("q", "2020-12-31", None, "x", "2019-01-01"))
    return e.select("event_id", b.alias("b")).select("event_id", F.date_format("b.low", "yyyy-MM-dd").alias("low"), F.date_format("b.high", "yyyy-MM-dd").alias("high"), "b.unknown")


@query(
    """with b as (select page_id, url, repeat('anchor ', 1 + page_id % 9) as anchor, regexp_extract(url, '^([^?#]*)', 1) as bare from pages where url is not null),
h as (select *, substr(bare, 1, greatest(1, least(length(bare), 59))) as head, url || chr(10) || anchor as whole from b), t as (select *, case when length(whole) <= 60 then whole else head || chr(10) || substr(anchor, 1, greatest(0, 59 - length(head))) end as text from h)
select page_id, text, length(whole) - length(text) as cut from t"""
)
def link_inputs(spark, sf_dir):
    x = T.link_input(F.col("url"), F.expr("repeat('anchor ', cast(1 + page_id % 9 as int))"), 60)
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", x.alias("x")).select("page_id", "x.text", "x.cut")


_TITLES = ("A title", "", None, "www.Site.example", "site.example")


@query(f"select page_id, {_sql_of('page_id', 'A title', 'a b 2x told', 'a b 2x told', 'www.Site.example a b 2x told', 'site.example a b 2x told')} as anchor from pages")
def scoring_anchors(spark, sf_dir):
    """A title stands alone unless it is empty or the bare host; then words of the path and the snippet follow."""
    out = T.scoring_anchor(F.lit("https://www.site.example/a_b/2x-17.html?99"), _one_of("page_id", *_TITLES), F.lit(" told "))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("anchor"))


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn) || chr(10) || chr(10) || '{\"id\":' || conv_id || '}' as packet from conversations group by conv_id")
def judge_packets(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("w"))
    return w.select("conv_id", R.packet(F.col("w"), F.struct(F.col("conv_id").alias("id"))).alias("packet"))


@query("select conv_id, sha256('{\"model\":\"m\",\"texts\":[' || string_agg('\"q: ' || role || '\"', ',' order by turn) || ']}') as digest from conversations group by conv_id")
def request_digests(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("t"))
    return w.select("conv_id", R.request_digest(F.lit("m"), "q: ", F.col("t")).alias("digest"))


@query(
    """with r as (select doc_id, min(doc_id) over (partition by text) as rep, source as url, text from documents where text is not null), o as (select rep, url, min(doc_id) as seq from r group by all)
select rep as representative, string_agg(coalesce(url, '-'), ',' order by seq) as urls, count(*) as copies from o group by rep"""
)
def duplicate_occurrences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    rep = d.join(d.groupBy("sha").agg(F.min("doc_id").alias("representative")), "sha").select(F.col("doc_id").alias("doc"), "representative")
    return D.occurrences(rep, d, "doc_id", "source", F.col("sha"), "doc_id").select("representative", F.array_join("urls", ",").alias("urls"), "copies")


@query(
    """with recursive c as (select conv_id, turn, length(text) + 3 as n, row_number() over (partition by conv_id order by turn) as i from conversations),
f as (select conv_id, turn, i, 0 as b, 1 as k, n as s from c where i = 1 union all select c.conv_id, c.turn, c.i, case when f.k + 1 > 3 or f.s + c.n > 600 then f.b + 1 else f.b end, case when f.k + 1 > 3 or f.s + c.n > 600 then 1 else f.k + 1 end, case when f.k + 1 > 3 or f.s + c.n > 600 then c.n else f.s + c.n end from f join c on c.conv_id = f.conv_id and c.i = f.i + 1)
select conv_id, turn, b::int - min(b) over (partition by conv_id)::int as batch from f"""
)
def encoder_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = S.pack(c, "conv_id", "turn", F.length("text") + 3, 3, 600).select("conv_id", "turn", "batch")
    first = out.groupBy(F.col("conv_id").alias("c")).agg(F.min("batch").alias("f"))
    return out.join(first, F.col("conv_id") == F.col("c")).select("conv_id", "turn", (F.col("batch") - F.col("f")).alias("batch"))


@query("select doc_id from (select doc_id, sum(n_chars) over (partition by source order by doc_id) as s from documents where n_chars is not null) where s <= 20000")
def evidence_budget(spark, sf_dir):
    return S.within_budget(table(spark, sf_dir, "documents").where("n_chars is not null"), "source", "doc_id", F.col("n_chars"), 20000).select("doc_id")


@query(
    """with q as (select event_id, event_type || '-' || event_id % 97 as text from events), f as (select text, min(event_id) as seq from q where text not in (select text from q where event_id % 10 = 0) group by text),
o as (select *, row_number() over (order by seq) as n from f), c as (select *, sum(length(text)) over (order by seq) as s from o where n <= 150) select seq as event_id, text from c where s <= 900"""
)
def new_queries(spark, sf_dir):
    q = table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", (F.col("event_id") % 97).cast("string")).alias("text"))
    return R.new_queries(q, q.where("event_id % 10 = 0"), "text", "event_id", 150, 900).select("event_id", "text")


@query("select doc_id, case when length(text) >= 30 and doc_id % 10 >= 5 and doc_id % 7 >= 1 then lang else 'und' end as language, length(text) >= 30 and doc_id % 10 >= 5 and doc_id % 7 >= 1 and lang <> 'en' as disagrees from documents where text is not null and lang is not null")
def language_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null").withColumn("declared", F.lit("EN-us"))
    out = html.language(d, F.col("lang"), (F.col("doc_id") % 10) / 10, (F.col("doc_id") % 7) / 10, "text", "declared")
    return out.select("doc_id", "language", "disagrees")


@query("select conv_id, turn, case when turn % 3 = 0 then 'https://a.example/' || conv_id || ',http://b.example/x' when turn % 3 = 1 then 'http://c.example/q?a=1' else '' end as urls from conversations")
def text_references(spark, sf_dir):
    """Addresses inside prose: marks at the end go, repeats count once, two at most."""
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("see https://a.example/"), "conv_id", F.lit("). And <http://b.example/x>, https://a.example/"), "conv_id", F.lit("; http://d.example"))).when(F.col("turn") % 3 == 1, F.lit("[http://c.example/q?a=1] and http://c.example/q?a=1:")).otherwise("none")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(html.text_references(said, 2), ",").alias("urls"))


@query(
    """with a as (select conv_id, turn, turn % 2 = 1 as g, turn % 4 = 2 as ok from conversations), w as (select *, sum(g::int) over (partition by conv_id order by turn) as n, lag(ok) over (partition by conv_id order by turn) as p from a)
select conv_id, reason, count(*) as n from (select conv_id, case when p then 'after_success' when n > 1 then 'second_retry' when g and p is null then 'first_generic' end as reason from w) where reason is not null group by all"""
)
def extraction_attempts(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 2 == 1).alias("generic"), (F.col("turn") % 4 == 2).alias("succeeded"))
    return R.attempt_violations(a, "conv_id", "turn").groupBy("conv_id", "reason").agg(F.count("*").alias("n"))


@query(
    """with recursive e as (select o_custkey % 200 as a, (o_custkey * 7 + 1) % 200 as b from orders where o_orderkey % 11 = 0), w as (select a as x, b as y from e union select b, a from e),
r as (select range as node, range as seen from range(200) union select r.node, w.y from r join w on r.seen = w.x)
select distinct node, min(seen) as seed from r where seen < 20 and (node < 20 or node in (select x from w)) group by node"""
)
def bundle_closure(spark, sf_dir):
    """All nodes that alias edges tie to a seed, and the least such seed."""
    e = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").selectExpr("o_custkey % 200 as source", "(o_custkey * 7 + 1) % 200 as target").where("source <> target")
    return G.closure(spark.range(20).select(F.col("id").alias("node")), e, "node").distinct()


@query("select distinct regexp_extract(event_type || ' fitted:' || event_id % 30 || ' from:' || user_id % 40, 'from:([0-9]+)', 1) as binding from events")
def plan_bindings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit(" fitted:"), F.col("event_id") % 30, F.lit(" from:"), F.col("user_id") % 40).alias("reason"))
    return R.plan_bindings(e, "reason", "from:([0-9]+)")


@query("select event_id, case when event_type = 'purchase' then 'missing amount' else 'unexpected amount' end as violation from events where (event_type = 'purchase' and event_id % 3 = 0) or (event_type = 'view' and event_id % 5 = 1)")
def event_contracts(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(((F.col("event_type") == "purchase") & (k % 3 != 0)) | ((F.col("event_type") == "view") & (k % 5 == 1)), 1).alias("amount"))
    rules = spark.createDataFrame([("purchase", "amount", True), ("view", "amount", False)], "event string, column string, required boolean")
    return L.contract_violations(e, "event_type", rules).select("event_id", F.array_join("violations", ",").alias("violation"))


@query("select doc_id, side from (select doc_id, 'left' as side from documents where doc_id % 4 = 0 union all select doc_id, 'right' from documents where doc_id % 4 = 1 union all select doc_id, unnest(['left', 'right']) from documents where doc_id % 4 = 2)")
def replay_differences(spark, sf_dir):
    """A log against its recomputation: rows that only one has, and rows whose value differs, on both sides."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("v").alias("v"))
    right = d.where("doc_id % 4 > 0").withColumn("v", F.when(F.col("doc_id") % 4 == 2, "w").otherwise(F.col("v")))
    return L.differences(d.where("doc_id % 4 <> 1"), right).select("doc_id", "side")


@query("select conv_id, turn, case when conv_id % 5 = 0 and turn = 0 then 'missing' when conv_id % 7 = 3 and turn = 1 then 'repeated' end as reason from conversations where (conv_id % 5 = 0 and turn = 0) or (conv_id % 7 = 3 and turn = 1)")
def pair_coverage(spark, sf_dir):
    """A proposal must cover every pair once."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    given = c.where("not (conv_id % 5 = 0 and turn = 0)")
    return P.bijection_violations(c, given.union(given.where("conv_id % 7 = 3 and turn = 1")), ["conv_id", "turn"])


@query("select event_id from events where event_id % 13 = 4")
def usage_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id as p", "length(props) as c", "user_id + length(props) + if(event_id % 13 = 4, 1, 0) as t")
    return L.usage_violations(e, "p", "c", "t").select("event_id")


@query("select event_id, user_id, event_type from events")
def journal_round_trip(spark, sf_dir):
    """The log written as lines of JSON, one row each, and read back with its schema."""
    import uuid

    path = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    files.write_journal(e, path, "user_id", "event_id")
    return files.read_journal(spark, path, "event_id long, user_id long, event_type string", "user_id", "event_id").select("event_id", "user_id", "event_type")


@query("select conv_id, turn as ordinal, 'http://n' || turn || '.onion/' as url, substr(case when turn % 2 = 0 then 'meta of ' || role else 'content' end, 1, 9) as snippet from conversations where conv_id % 3 <> 1 and turn % 5 <> 3 and turn % 4 <> 3 and turn <> 6")
def onion_hits(spark, sf_dir):
    """An index's answers: partial ones count for nothing; banned, stale and foreign hits are left out."""
    t = F.col("turn")
    host = F.concat(F.lit("http://n"), "turn", F.when(t == 6, ".com/").otherwise(".onion/"))
    source = F.struct(host.alias("url"), F.lit("t").alias("title"), F.when(t % 2 == 0, F.concat(F.lit("meta of "), "role")).otherwise(" ").alias("meta"), F.lit("content").alias("content"), (t % 5 == 3).alias("is_banned"), F.when(t % 4 == 3, 10.0).otherwise(990.0).alias("updated_on"))
    hits = F.transform(F.sort_array(F.collect_list(F.struct("turn", source.alias("_source")))), lambda x: F.struct(x["_source"].alias("_source")))
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct((F.col("conv_id") < 0).alias("timed_out"), F.struct(F.when(F.col("conv_id") % 3 == 1, 1).otherwise(0).alias("failed")).alias("_shards"), F.struct(hits.alias("hits")).alias("hits"))).alias("raw"))
    out = files.onion_search(r, "conv_id", "raw", F.lit(1000.0), 100, 9, lambda h: F.endswith(h, F.lit(".onion")))
    return out.select("conv_id", "ordinal", "url", "snippet")


@query("select conv_id, count(*) as entries, 'https://e.example/' || max(case when turn = 0 then role end) as first_link from conversations group by conv_id having min(turn) = 0")
def feed_readings(spark, sf_dir):
    """Feeds made of conversations: one entry for each turn, read back."""
    item = F.concat(F.lit("<item><title>t"), "turn", F.lit("</title><link>https://e.example/"), "role", F.lit("</link><description>d</description></item>"))
    f = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("m"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda x: x["x"]), "").alias("x")).where("m = 0")
    raw = f.select("conv_id", F.concat(F.lit("<rss version=\"2.0\"><channel><title>c</title>"), "x", F.lit("</channel></rss>")).cast("binary").alias("raw"), F.lit("https://e.example/feed").alias("base"))
    found = feeds.feed_entries(raw, "conv_id", "raw", "base")
    return found.groupBy("conv_id").agg(F.count("*").alias("entries"), F.min_by(F.get("urls", F.lit(0)), "ordinal").alias("first_link"))


@query("select conv_id, case when conv_id % 5 <> 0 then turn end as ordinal, case when conv_id % 5 <> 0 then case when turn % 2 = 0 then 'https://s.example/r/' || turn else 'https://o.example/' || turn end end as url, case when conv_id % 5 <> 0 then 't ' || role end as title, case when conv_id % 5 <> 0 then 'a snippet' end as snippet, case when conv_id % 5 = 0 then 'unknown layout' end as error from conversations where turn < 4 and (conv_id % 5 <> 0 or turn = 0)")
def search_pages(spark, sf_dir):
    """Pages of a search interface, made of turns; every fifth has another layout and is refused."""
    t = F.col("turn")
    item = F.concat(F.lit('<article class="result x"><h3><a href="'), F.when(t % 2 == 0, F.concat(F.lit("/r/"), t)).otherwise(F.concat(F.lit("https://o.example/"), t)), F.lit('">t <b>'), "role", F.lit('</b></a></h3><p class="content">a<br> <i>snippet</i><script>x</script></p><p>no</p></article>'))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda x: x["x"]), "").alias("x"))
    page = c.select("conv_id", F.lit("https://s.example/search?q=1").alias("url"), F.concat(F.when(F.col("conv_id") % 5 == 0, "<div>").otherwise('<article class="result"></article><div id="results"><div id="urls">'), "x", F.lit("</div></div>")).alias("html"))
    return feeds.search_pages(page, "conv_id", "url", "html", 4)


@query("select conv_id, case when conv_id % 4 <> 0 then turn end as ordinal, case when conv_id % 4 <> 0 then case when turn % 3 = 1 then 'ftp://x/' else 'https://l.example/' || turn end end as url, case when conv_id % 4 <> 0 and turn % 2 = 0 then role end as title, case when conv_id % 4 = 0 then 'no_list' when turn >= 5 then 'limit' when turn % 3 = 1 then 'no_url' end as reason from conversations where conv_id % 4 <> 0 or turn = 0")
def lead_envelopes(spark, sf_dir):
    """Envelopes of a tool's answer, whose list and fields lie where a configuration says."""
    t = F.col("turn")
    lead = F.struct(F.struct(F.when(t % 3 == 1, "ftp://x/").otherwise(F.concat(F.lit("https://l.example/"), t)).alias("href")).alias("link"), F.when(t % 2 == 0, F.col("role")).alias("name"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", lead.alias("x")))), lambda x: x["x"]).alias("x"))
    raw = F.when(F.col("conv_id") % 4 == 0, F.lit('{"result":{}}')).otherwise(F.to_json(F.struct(F.struct(F.col("x").alias("hits")).alias("result"))))
    return feeds.lead_envelopes(c.select("conv_id", raw.alias("raw")), "conv_id", "raw", "result.hits", {"url": "link.href", "title": "name"}, 5)
