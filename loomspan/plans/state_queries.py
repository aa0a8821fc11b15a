"""Registered queries on the event log: folds, chains, receipts and queues, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import state as S
from ..sources.shared import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _micros():
    """Microseconds since 1970, whatever the session's zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    """with p as (select user_id, event_id, (event_type in ('signup', 'purchase'))::int as n, (row_number() over (partition by user_id order by event_id) - 1) // 10 as w from events where event_type <> 'click'),
g as (select user_id, w, count(*) as fetches, sum(n)::bigint as new from p group by all), s as (select *, fetches >= 10 and new < 3 as saturated from g)
select user_id, w::int as "window", fetches, new, saturated, coalesce((min(case when saturated then w end) over (partition by user_id))::int, -1) as stopped_at from s"""
)
def saturation_windows(spark, sf_dir):
    """Windows of ten page events of each user; clicks stand for searches, sign-ups and purchases for new documents."""
    out = S.saturation_windows(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") != "click", F.col("event_type").isin("signup", "purchase"), 10, 3)
    return out.withColumn("stopped_at", F.coalesce("stopped_at", F.lit(-1)))


_RUN = """b as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as island from events),
r as (select *, (sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, island order by event_id rows unbounded preceding))::int as run from b)"""


@query(f'with {_RUN} select event_id, user_id, run as failures, run >= 2 as "open" from r')
def circuit_breaker(spark, sf_dir):
    return S.circuit_breaker(_events(spark, sf_dir), "user_id", ["event_id"], F.col("event_type") == "error", 2).select("event_id", "user_id", "failures", "open")


@query(f"with {_RUN} select user_id, max(run) as longest, count(*) as calls, round(sum(value), 4) as total, sum(length(props))::bigint as bytes from r group by user_id")
def failure_runs(spark, sf_dir):
    out = S.run_length(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "error")
    return out.groupBy("user_id").agg(F.max("run").alias("longest"), F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.length("props")).alias("bytes"))


@query(
    """with recursive d as (select user_id, cast(ts as date) as day, bool_or(event_type = 'purchase') as p from events group by all),
o as (select *, row_number() over (partition by user_id order by day) as i from d),
f as (select user_id, 0::bigint as i, null::date as day, 0 as n, 0 as c from (select distinct user_id from o)
 union all select o.user_id, o.i, o.day, case when not o.p and f.n + 1 >= 2 and f.c < 3 then 0 when o.p then 0 else f.n + 1 end, case when not o.p and f.n + 1 >= 2 and f.c < 3 then f.c + 1 else f.c end from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, strftime(day, '%Y-%m-%d') as day, n::int as stagnant, c::int as changes, (c % 4)::int as "offset" from f where i > 0"""
)
def stagnation_rotation(spark, sf_dir):
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("p"))
    out = S.stagnation(days, ["user_id"], "day", F.col("p"), 2, 3, 4)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "stagnant", "changes", F.col("offset").cast("int").alias("offset"))


@query(
    """with e as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by event_id rows unbounded preceding) as ep from events),
b as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id, ep order by event_id rows unbounded preceding) as isl from e),
m as (select *, (sum((event_type = 'error')::int) over (partition by user_id, ep, isl order by event_id rows unbounded preceding))::int as misses from b)
select event_id, misses, max((misses >= 2)::int) over (partition by user_id, ep order by event_id rows unbounded preceding) = 1 as latched from m"""
)
def locator_drift_latch(spark, sf_dir):
    out = S.locator_latch(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "error", F.col("event_type") == "signup", 2)
    return out.select("event_id", "misses", "latched")


@query(
    """with recursive o as (select user_id, event_id, epoch_us(ts) / 1000000.0 as at, event_type = 'error' as t, value as w, row_number() over (partition by user_id order by event_id) as i from events),
f as (select user_id, 0::bigint as i, null::bigint as event_id, 0.0::double as b, '-infinity'::double as r from (select distinct user_id from o)
 union all select o.user_id, o.i, o.event_id, k.b, case when o.t then greatest(f.r, o.at + greatest(k.b, o.w)) else f.r end from f join o on o.user_id = f.user_id and o.i = f.i + 1,
 lateral (select (case when o.t then case when f.b = 0 then 5.0 else least(120.0, f.b * 2) end when o.at >= f.r then 0.0 else f.b end)::double as b) k)
select event_id, b as backoff, round(coalesce(case when r > -1e300 then r end, 0), 3) as ready_at from f where i > 0"""
)
def throttle_backoff(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("at", _micros() / 1000000.0)
    out = S.throttle_backoff(e, "user_id", "event_id", "at", F.col("event_type") == "error", F.col("value"))
    return out.select("event_id", "backoff", F.round(F.when(F.col("ready_at") > -1e300, F.col("ready_at")).otherwise(0.0), 3).alias("ready_at"))


@query(
    """with recursive o as (select user_id, event_id, epoch_us(ts) / 1000000.0 as at, row_number() over (partition by user_id order by event_id) as i from events),
f as (select user_id, 0::bigint as i, null::bigint as event_id, null::double as t, '-infinity'::double as free from (select distinct user_id from o)
 union all select o.user_id, o.i, o.event_id, greatest(f.free, o.at), greatest(f.free, o.at) + 7200 + (o.event_id % 3) from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select event_id, round(t, 3) as starts_at from f where i > 0"""
)
def polite_schedule(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("at", _micros() / 1000000.0)
    return S.polite_schedule(e, "user_id", "event_id", "at", 7200 + F.col("event_id") % 3).select("event_id", F.round("starts_at", 3).alias("starts_at"))


@query(
    """with c as (select user_id, event_id, ts from events where event_type = 'click'), v as (select user_id, ts, event_id as version, value from events where event_type = 'view')
select c.event_id, coalesce(v.version, -1) as version, coalesce(v.value, 0) as value from c asof left join v on c.user_id = v.user_id and c.ts >= v.ts"""
)
def latest_version_asof(spark, sf_dir):
    """The last view of the same user at or before each click."""
    e = _events(spark, sf_dir)
    out = S.latest_version_asof(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("version"), "value"), "user_id", "ts", ["version", "value"])
    return out.select("event_id", F.coalesce("version", F.lit(-1)).alias("version"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query(
    """select user_id, count(*) filter (event_type <> 'error') as fetches, count(*) filter (event_type = 'click') as searches, count(*) filter (event_type = 'purchase') as judge_calls, round(sum(case when event_type = 'view' then value else 0 end), 4) as bytes,
greatest(0, count(*) filter (event_type <> 'error') - count(*) filter (event_type = 'click')) as page_fetches from events group by user_id"""
)
def spend_receipt(spark, sf_dir):
    kind = F.col("event_type")
    out = L.receipt(_events(spark, sf_dir), ["user_id"], {"fetches": kind != "error", "searches": kind == "click", "judge_calls": kind == "purchase"}, {"bytes": F.when(kind == "view", F.col("value")).otherwise(0.0)})
    return out.select("user_id", "fetches", "searches", "judge_calls", F.round("bytes", 4).alias("bytes"), "page_fetches")


def _items(e: DataFrame) -> DataFrame:
    at = F.floor(_micros() / 1000000)
    return e.select("event_id", F.when(F.col("event_type") == "purchase", "acknowledged").otherwise("pending").alias("state"), (F.col("event_id") % 6).cast("int").alias("attempts"), F.when(F.col("event_id") % 4 != 0, at).alias("next_attempt"), F.when(F.col("event_type") == "view", at + 3600).alias("lease_until"))


_ITEMS = """i as (select event_id, case when event_type = 'purchase' then 'acknowledged' else 'pending' end as state, event_id % 6 as attempts, case when event_id % 4 <> 0 then epoch(ts)::bigint end as next_attempt, case when event_type = 'view' then epoch(ts)::bigint + 3600 end as lease_until from events),
n as (select max(epoch(ts)::bigint) - 864000 as now from events)"""


def _now(e: DataFrame):
    return F.lit(e.agg(F.max(F.floor(_micros() / 1000000)) - 864000).first()[0])


@query(
    f"""with {_ITEMS} select count(*) filter (state = 'acknowledged') as acknowledged, count(*) filter (state <> 'acknowledged' and attempts >= 5) as exhausted, count(*) filter (state <> 'acknowledged' and attempts < 5 and coalesce(lease_until > now, false)) as leased,
 count(*) filter (state <> 'acknowledged' and attempts < 5 and not coalesce(lease_until > now, false) and coalesce(next_attempt <= now, true)) as due, count(*) filter (state <> 'acknowledged' and attempts < 5 and not coalesce(lease_until > now, false) and not coalesce(next_attempt <= now, true)) as waiting from i, n"""
)
def outbox_summary(spark, sf_dir):
    e = _events(spark, sf_dir)
    return S.outbox_summary(_items(e), _now(e), 5)


@query(f"with {_ITEMS} select event_id from i, n where state <> 'acknowledged' and attempts < 5 and coalesce(next_attempt <= now, true) and not coalesce(lease_until > now, false) order by event_id limit 25")
def outbox_claim(spark, sf_dir):
    e = _events(spark, sf_dir)
    return S.outbox_claim(_items(e), "event_id", _now(e), 5, 25).select("event_id")


_FIELD = "octet_length(encode({0}))::varchar || ':' || {0}"
_DIG = f"sha256({_FIELD.format('{0}')} || {_FIELD.format('e.event_id::varchar')} || {_FIELD.format('e.event_type')} || {_FIELD.format('e.props')})"


@query(
    f"""with recursive e as (select *, row_number() over (partition by user_id order by event_id) as n from events),
c as (select user_id, n, event_id, {_DIG.format("''")} as digest, '' as previous_sha256 from e where n = 1 union all select e.user_id, e.n, e.event_id, {_DIG.format('c.digest')}, c.digest from c join e on e.user_id = c.user_id and e.n = c.n + 1)
select event_id, digest, previous_sha256 from c"""
)
def ledger_hash_chain(spark, sf_dir):
    out = L.hash_chain(_events(spark, sf_dir), ["user_id"], "event_id", "event_type", "props")
    return out.select("event_id", "digest", F.coalesce("previous_sha256", F.lit("")).alias("previous_sha256"))


@query("select user_id, event_id, 'digest' as reason from events where event_id % 97 = 0")
def ledger_violations(spark, sf_dir):
    """The chain of the log after every 97th entry was changed behind its back: its digest no longer fits."""
    log = _events(spark, sf_dir).withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1)
    forged = L.hash_chain(log, ["user_id"], "seq", "event_type", "props").withColumn("props", F.when(F.col("event_id") % 97 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    found = L.chain_violations(forged, ["user_id"], "seq", "event_type", "props")
    return found.join(log.select("user_id", "seq", "event_id"), ["user_id", "seq"]).select("user_id", "event_id", "reason")


@query(
    """with x as (select user_id, event_id, (event_type = 'purchase')::int as k from events where event_type in ('view', 'purchase')), n as (select *, lead(k) over w as nk, lead(event_id) over w as ns from x window w as (partition by user_id order by event_id))
select user_id, event_id as intent_seq, coalesce(case when nk = 1 then ns end, -1) as answer_seq from n where k = 0"""
)
def intent_ack_pairing(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = L.paired(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "event_id", "event_id")
    return out.select("user_id", "intent_seq", F.coalesce("answer_seq", F.lit(-1)).alias("answer_seq"))


@query("with i as (select user_id, event_id from events where event_type = 'view'), a as (select user_id, event_id - 1 as event_id from events where event_type = 'click') select user_id, event_id from i anti join a using (user_id, event_id)")
def unanswered_intents(spark, sf_dir):
    e = _events(spark, sf_dir)
    return L.unanswered(e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'click'").select("user_id", (F.col("event_id") - 1).alias("of")), ["user_id"], "event_id", "of")


@query("with n as (select user_id, sum(case event_type when 'view' then 1 when 'purchase' then -1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as n from events) select user_id, max(n)::bigint as pending from n group by user_id")
def most_pending(spark, sf_dir):
    return L.most_pending(_events(spark, sf_dir), ["user_id"], "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("select user_id, count(*) as items, sha256(string_agg(event_id::varchar, ',' order by event_id::varchar)) as digest from events group by user_id")
def population_digest(spark, sf_dir):
    return L.population_digest(_events(spark, sf_dir), ["user_id"], "event_id")


@query("select e.event_id from events e where event_type = 'purchase' and exists (select 1 from events f where f.user_id = e.user_id and f.event_type = 'view' and f.event_id < e.event_id and f.event_id > e.event_id - 300)")
def fetch_before(spark, sf_dir):
    """Purchases that a view of the same user, not more than 300 entries back, stands before."""
    e = _events(spark, sf_dir)
    rows = e.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("event_id") - 300).alias("after"))
    return L.between(rows, e.where("event_type = 'view'"), "user_id", "event_id", "event_id", "after").select("event_id")


@query("with d as (select user_id, cast(ts as date) as day, count(*) filter (event_type = 'purchase') as new from events group by all), b as (select *, sum((new > 0)::int) over (partition by user_id order by day rows unbounded preceding) as i from d), q as (select *, sum((new = 0)::int) over (partition by user_id, i order by day rows unbounded preceding) as quiet from b) select user_id, strftime(day, '%Y-%m-%d') as day, quiet::int as quiet, quiet >= 2 as saturated from q")
def research_saturation(spark, sf_dir):
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("new"))
    return S.quiet_rounds(days, ["user_id"], "day", "new").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "quiet", "saturated")


@query("with p as (select event_id, user_id, event_type as state, lag(event_type) over (partition by user_id order by event_id) as prev from events) select event_id, coalesce(prev, '') as previous, state from p where not coalesce(case when prev is null then state = 'view' when prev = 'view' then state in ('click', 'view', 'error') when prev = 'click' then state in ('purchase', 'view', 'click') when prev = 'error' then state = 'view' else false end, false)")
def state_transitions(spark, sf_dir):
    out = S.state_transitions(_events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("state")), "user_id", "event_id", "state", {"view": ("click", "view", "error"), "click": ("purchase", "view", "click"), "error": ("view",), "purchase": (), "signup": ()}, "view")
    return out.select("event_id", F.coalesce("previous", F.lit("")).alias("previous"), "state")


@query("with e as (select page_id, url, -((page_id * 31) % 17) / 16.0 as priority, (page_id % 4)::int as depth from pages), b as (select url, min((priority, page_id)) as m from e group by url), f as (select e.* from e join b on e.url = b.url and e.page_id = b.m[2]) select page_id, url, priority, depth from f where url not in (select url from pages where page_id % 10 = 0) order by priority, url, depth limit 60")
def frontier_order(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", (-((F.col("page_id") * 31) % 17) / 16.0).alias("priority"), (F.col("page_id") % 4).cast("int").alias("depth"))
    best = S.frontier(p.select("url", "priority", "page_id", "depth"), "url", "priority")
    seen = p.where("page_id % 10 = 0").select("url")
    return S.frontier_order(best, "priority", "url", "depth", seen, 60).select("page_id", "url", "priority", "depth")
