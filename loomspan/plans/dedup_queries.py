"""Registered queries on duplicates and urls, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import as_long, text_digest
from ..operators import dedup as D
from ..operators.filters import first_hosts
from ..sources.shared import spread, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_NORMAL = r"trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\s+', ' ', 'g'))"
_FP = rf"""
n as materialized (select doc_id, lang, text, {_NORMAL} as t from documents),
sh as (select doc_id, unnest(list_transform(range(0, greatest(1, length(t) - 4)), lambda i: substr(t, i + 1, 5))) as s from n),
cnt as (select doc_id, s, count(*) as w from sh group by all),
v as (select doc_id, ('0x' || substr(sha256(s), 1, 16))::ubigint as h, w from cnt),
bits as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then w else -w end) > 0 as up from v, (select unnest(range(64)) as b) group by doc_id, b),
fp as materialized (select n.doc_id, lang, sha256(coalesce(text, '')) as source_sha, sha256(t) as text_sha, length(t) as chars, sim, array_to_string(regexp_extract_all(t, '\d+(?:[.,]\d+)*'), ' ') as numbers
  from n join (select doc_id, sum(case when up then 1::ubigint << b else 0::ubigint end)::ubigint as sim from bits group by doc_id) s using (doc_id))"""
_PAIRS = f"""{_FP},
cls as (select lang, text_sha, min(doc_id) as doc_id from fp group by all),
f as materialized (select fp.* from fp join cls using (doc_id)),
k as materialized (select *, unnest([0, 1, 2, 3]) as b from f),
kk as materialized (select *, (sim >> (16 * b)) & 65535 as key from k),
near as materialized (select distinct a.doc_id as l, c.doc_id as r, bit_count(xor(a.sim, c.sim))::int as hamming from kk a join kk c on a.lang = c.lang and a.b = c.b and a.key = c.key and a.doc_id < c.doc_id
  where a.lang <> 'und' and bit_count(xor(a.sim, c.sim)) <= 3 and least(a.chars, c.chars) >= 100 and least(a.chars, c.chars) >= 0.9 * greatest(a.chars, c.chars) and a.numbers = c.numbers)"""


def _fp(spark, sf_dir):
    return D.fingerprints(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "lang")


@query(f"select doc_id, sha256({_NORMAL}) as text_sha256 from documents")
def normalized_text_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_digest(F.coalesce("text", F.lit(""))).alias("text_sha256"))


@query(f"with {_FP} select doc_id, source_sha, text_sha, printf('%016x', sim) as simhash, chars::int as normal_chars from fp")
def simhash_fingerprints(spark, sf_dir):
    return _fp(spark, sf_dir).select(F.col("doc").alias("doc_id"), "source_sha", "text_sha", "simhash", "normal_chars")


@query(f"with {_FP}, k as (select doc_id, sim, unnest([0, 1, 2, 3]) as band from fp) select doc_id, band::int as band, (((sim >> (16 * band)) & 65535)::ubigint)::varchar as key from k")
def simhash_bands(spark, sf_dir):
    return D.bands(_fp(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.col("band").cast("int").alias("band"), "key")


@query(f"select doc_id, min(doc_id) over (partition by lang, sha256({_NORMAL})) as first_doc_id from documents")
def exact_duplicates_text(spark, sf_dir):
    return D.exact_duplicates(_fp(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.col("first").alias("first_doc_id"))


@query(f"with {_PAIRS} select l as left_doc_id, r as right_doc_id, hamming from near")
def near_duplicate_pairs(spark, sf_dir):
    return D.near_pairs(_fp(spark, sf_dir)).select(F.col("left").alias("left_doc_id"), F.col("right").alias("right_doc_id"), "hamming")


@query(
    f"""with recursive {_PAIRS},
mem as (select f.doc_id as first, fp.doc_id from f join fp using (lang, text_sha)),
e as materialized (select distinct least(x, y) as l, greatest(x, y) as r, rank, hamming from (
  select a.doc_id as x, c.doc_id as y, 0 as rank, 0 as hamming from fp a join fp c on a.source_sha = c.source_sha and a.doc_id < c.doc_id
  union all select a.doc_id, c.doc_id, 1, 0 from fp a join fp c on a.lang = c.lang and a.text_sha = c.text_sha and a.doc_id < c.doc_id
  union all select m.doc_id, q.doc_id, 2, hamming from near join mem m on m.first = l join mem q on q.first = r)),
n_doc as (select doc_id, row_number() over (order by doc_id) as i from fp),
step as (select 0::bigint as i, []::bigint[] as reps
  union all select d.i, case when exists (select 1 from e where e.r = d.doc_id and list_contains(step.reps, e.l)) then reps else list_append(reps, d.doc_id) end from step join n_doc d on d.i = step.i + 1),
reps as materialized (select unnest(reps) as doc_id from step where i = (select count(*) from fp)),
best as (select r as doc_id, min((rank, hamming, l)) as m from e join reps on reps.doc_id = e.l group by r)
select fp.doc_id, coalesce(case when reps.doc_id is null then m[3] end, fp.doc_id) as representative, case when reps.doc_id is not null then 'representative' when m[1] = 0 then 'content_sha256' when m[1] = 1 then 'normalized_text' else 'simhash' end as reason,
  coalesce(case when reps.doc_id is null then m[2] end, 0)::int as hamming
from fp left join reps on reps.doc_id = fp.doc_id left join best on best.doc_id = fp.doc_id"""
)
def duplicate_leaders(spark, sf_dir):
    return D.leaders(_fp(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "representative", "reason", F.col("hamming").cast("int").alias("hamming"))


@query(
    f"""with p as (select source, doc_id, sha256(text) as s, sha256({_NORMAL}) as t, lag(doc_id) over w as pd, lag(sha256(text)) over w as ps, lag(sha256({_NORMAL})) over w as pt from documents window w as (partition by source order by doc_id))
select source, pd as previous_doc_id, doc_id, case when pt <> t then 'changed_native_text' else 'changed_source_bytes' end as reason from p where pd is not null and (ps <> s or pt <> t)"""
)
def content_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s"), text_digest(F.col("text")).alias("t"))
    return D.content_drift(d, "source", "doc_id", "s", "t").select(F.col("key").alias("source"), F.col("previous_seq").alias("previous_doc_id"), F.col("seq").alias("doc_id"), "reason")


@query("select source, max(doc_id) as doc_id, sha256(arg_max(text, doc_id)) as source_sha from documents group by source")
def current_revisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("source_sha"))
    return D.current_revisions(d, "source", "doc_id")


@query(
    r"""with b as (select item_id, lower(regexp_replace(text, '\s+', ' ', 'g')) as t from benchmark), bs as (select distinct substr(t, i, 40) as s, item_id from (select item_id, t, unnest(range(1, length(t) - 38, 40)) as i from b) where length(substr(t, i, 40)) = 40),
d as (select doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
select item_id, count(distinct doc_id) as documents, min(doc_id) as first_doc_id from d join bs on contains(d.t, bs.s) group by item_id"""
)
def benchmark_overlap(spark, sf_dir):
    """Benchmark items of which a stretch of 40 characters, from a multiple of 40, occurs in a document."""
    from ..operators.overlap import stretch_overlap

    out = stretch_overlap(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 40)
    return out.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc_id"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1))"


@query(
    rf"""with p as (select page_id, regexp_extract(url, '^([a-z]+)://', 1) as s, {_HOST} as h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '\?([^#]*)', 1) as q from pages),
k as (select *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_') and not lower(string_split(x, '=')[1]) in ('fbclid', 'gclid')), '&') as kq from p)
select page_id, s || '://' || h || case when p = '' then '/' else p end || case when kq = '' then '' else '?' || kq end as canonical from k"""
)
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url()(F.col("url")).alias("canonical"))


@query(rf"select page_id, url from pages where starts_with(url, 'https://') and regexp_matches({_HOST}, '\.example\.org$') and {_HOST} in (select distinct {_HOST} from pages where page_id % 2 = 0)")
def url_scope_filter(spark, sf_dir):
    """Pages on https whose host is in scope; the scope is a table of hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    scope = p.where("page_id % 2 = 0").select(U.host(F.col("url")).alias("host")).where(F.endswith("host", F.lit(".example.org"))).distinct()
    ok = U.plain_web(F.col("url")) & (U.port(F.col("url")) == 443)
    return p.where(ok).withColumn("host", U.host(F.col("url"))).join(scope, "host", "left_semi").select("page_id", "url")


@query(rf"with f as (select {_HOST} as h, min(page_id) as first from pages group by 1), r as (select h, row_number() over (order by first) as n from f) select page_id, {_HOST} as host from pages where {_HOST} in (select h from r where n <= 20)")
def first_host_cap(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return first_hosts(p, "host", "page_id", 20)


@query(rf"select {_HOST} as host, count(*) as pages, count(distinct regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) as paths, bool_or(starts_with(url, 'http://')) as plain_http from pages group by 1")
def host_report(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(U.path(F.col("url"))).alias("paths"), F.bool_or(U.scheme(F.col("url")) == "http").alias("plain_http"))
