"""Registered queries on the graph, identities and plans, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import prefixed_digest
from ..operators import graph as G
from ..operators import planning as Q
from ..sources.shared import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _id(role: str, *cols: str) -> str:
    return f"'{role}:' || sha256(" + " || ".join(f"octet_length(encode({c}))::varchar || ':' || {c}" for c in cols) + ")"


def _geo(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    s = lambda c: F.col(c).cast("string")
    nodes = G.nodes(nation, "place", F.col("n_name"), s("n_nationkey")).union(G.nodes(region, "area", F.col("r_name"), s("r_regionkey"))).union(G.nodes(customer.where("c_custkey % 7 <> 0"), "party", F.col("c_name"), s("c_custkey")))
    within = G.edges(nation, "within", prefixed_digest("place", s("n_nationkey")), prefixed_digest("area", s("n_regionkey")))
    lives = G.edges(customer, "lives_in", prefixed_digest("party", s("c_custkey")), F.when(F.col("c_custkey") % 11 == 0, prefixed_digest("area", s("c_nationkey"))).otherwise(prefixed_digest("place", s("c_nationkey"))))
    return nodes, within.union(lives)


_NODES = f"""n as (select {_id('place', 'n_nationkey::varchar')} as id, 'place' as role from nation union select {_id('area', 'r_regionkey::varchar')}, 'area' from region union select {_id('party', 'c_custkey::varchar')}, 'party' from customer where c_custkey % 7 <> 0),
e as (select 'within' as relation, {_id('place', 'n_nationkey::varchar')} as s, {_id('area', 'n_regionkey::varchar')} as t from nation
 union all select 'lives_in', {_id('party', 'c_custkey::varchar')}, case when c_custkey % 11 = 0 then {_id('area', 'c_nationkey::varchar')} else {_id('place', 'c_nationkey::varchar')} end from customer)"""


@query(f"with {_NODES} select id as node_id, role from n")
def graph_nodes(spark, sf_dir):
    return _geo(spark, sf_dir)[0].select("node_id", "role")


@query(f"""with {_NODES} select 'edge:' || sha256('{{"relation":"' || relation || '","source":"' || s || '","target":"' || t || '","evidence":null}}') as edge_id, relation, s as source, t as target from e""")
def graph_edges(spark, sf_dir):
    return _geo(spark, sf_dir)[1].select("edge_id", "relation", "source", "target")


@query(
    f"""with {_NODES} select e.relation, e.s as source, case when a.id is null then 'missing_source' when b.id is null then 'missing_target' else 'wrong_roles' end as reason
from e left join n a on a.id = e.s left join n b on b.id = e.t where a.id is null or b.id is null or not ((e.relation = 'within' and a.role = 'place' and b.role = 'area') or (e.relation = 'lives_in' and a.role = 'party' and b.role = 'place'))"""
)
def graph_edges_valid(spark, sf_dir):
    nodes, edges = _geo(spark, sf_dir)
    rules = spark.createDataFrame([("within", "place", "area"), ("lives_in", "party", "place")], "relation string, source_role string, target_role string")
    return G.edge_violations(edges, nodes, rules).join(edges, "edge_id").select("relation", "source", "reason")


_PART = """m as (select p_partkey as k, 'b' || p_brand || ':' || p_size as g from part where p_partkey % 3 = 0 union all select p_partkey, 't' || p_type || ':' || p_size from part where p_partkey % 5 = 0),
f as (select g, min(k) as f from m group by g), e as (select k as a, f as b from m join f using (g)), w as (select a, b from e union select b, a from e)"""


@query(f"with recursive {_PART}, r as (select a as node, b as seen from w union select r.node, w.b from r join w on r.seen = w.a) select node as p_partkey, min(seen) as component from r group by node")
def identity_components(spark, sf_dir):
    """Parts that share brand and size, or type and size, directly or through others."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    m = p.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("b"), "p_brand", F.lit(":"), size).alias("g")).union(p.where("p_partkey % 5 = 0").select("p_partkey", F.concat(F.lit("t"), "p_type", F.lit(":"), size)))
    first = m.groupBy("g").agg(F.min("p_partkey").alias("f"))
    return G.components(m.join(first, "g"), "p_partkey", "f").select(F.col("node").alias("p_partkey"), "component")


_DEC = """d as (select o_orderkey as seq, 'd' || o_orderkey as id, case when o_orderkey % 13 = 0 then 'retract' when o_orderkey % 5 = 0 then 'split' else 'merge' end as op, o_custkey as a, case when o_custkey % 7 = 0 then o_custkey + 1 else o_custkey - o_custkey % 7 end as b, case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) end as f, case when o_orderkey % 4 = 1 then cast(o_orderdate as date) + 400 end as t from orders),
gone as (select 'd' || (seq - 1) as id, seq as rs from d where op = 'retract'), act as (select d.* from d left join gone using (id) where op <> 'retract' and (rs is null or rs <= seq)),
held as (select * from act where (f is null or f <= date '1996-06-30') and (t is null or t >= date '1996-06-30'))"""


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    op = F.when(k % 13 == 0, "retract").when(k % 5 == 0, "split").otherwise("merge")
    return o.select(k.alias("seq"), F.concat(F.lit("d"), k).alias("decision_id"), op.alias("operation"), F.array("o_custkey", F.when(F.col("o_custkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey") - F.col("o_custkey") % 7)).alias("members"), F.when(k % 13 == 0, F.array(F.concat(F.lit("d"), k - 1))).alias("retracts"), F.when(k % 4 != 0, day).alias("valid_from"), F.when(k % 4 == 1, F.date_add(day, 400)).alias("valid_to"))


@query(
    f"""with recursive {_DEC}, w as (select a, b from held where op = 'merge' union select b, a from held where op = 'merge'), r as (select a as node, b as seen from w union select a, a from w union select r.node, w.b from r join w on r.seen = w.a), c as (select node, min(seen) as i from r group by node)
select c_custkey as node_id, coalesce(i, c_custkey) as identity from customer left join c on c.node = c_custkey"""
)
def identity_resolution(spark, sf_dir):
    """Customers as one identity where merges that hold on a date say so; orders stand for the decisions."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    return G.resolve_identities(nodes, _decisions(spark, sf_dir), "1996-06-30")[0]


@query(
    f"""with recursive {_DEC}, w as (select a, b from held where op = 'merge' union select b, a from held where op = 'merge'), r as (select a as node, b as seen from w union select a, a from w union select r.node, w.b from r join w on r.seen = w.a), c as (select node, min(seen) as i from r group by node)
select id as decision_id from held left join c x on x.node = a left join c y on y.node = b where op = 'split' and a in (select c_custkey from customer) and b in (select c_custkey from customer) and coalesce(x.i, a) = coalesce(y.i, b)"""
)
def split_conflicts(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    return G.resolve_identities(nodes, _decisions(spark, sf_dir), "1996-06-30")[1]


@query("with d as (select o_orderkey, o_custkey, o_orderpriority as target, case when o_orderkey % 9 <> 0 then cast(o_orderdate as date) end as lo, case when o_orderkey % 8 <> 0 then cast(o_orderdate as date) + 30 end as hi from orders where o_orderstatus = 'F') select a.o_orderkey as \"left\", b.o_orderkey as \"right\", a.o_custkey as subject, a.lo is null or a.hi is null or b.lo is null or b.hi is null as unknown_time from d a join d b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.target <> b.target and coalesce(a.lo, date '0001-01-01') <= coalesce(b.hi, date '9999-12-31') and coalesce(b.lo, date '0001-01-01') <= coalesce(a.hi, date '9999-12-31')")
def dated_disputes(spark, sf_dir):
    """Finished orders of one customer within a month of each other that name different priorities."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    c = o.select(k.alias("id"), F.lit("priority").alias("rule"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("target"), F.when(k % 9 != 0, day).alias("lo"), F.when(k % 8 != 0, F.date_add(day, 30)).alias("hi"))
    return G.disputes(c, "id", "rule", "subject", "target", "lo", "hi").select("left", "right", "subject", "unknown_time")


@query("with m as (select s_suppkey::varchar as n, s_nationkey from supplier), p as (select a.n as l, b.n as r, greatest(a.n::bigint, b.n::bigint) as newest from m a join m b on a.s_nationkey = b.s_nationkey and a.n < b.n) select sha256(least(l, r) || ':' || greatest(l, r)) as pair_id, l as \"left\", r as \"right\" from p")
def identity_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("n"), F.col("s_suppkey").cast("bigint").alias("t"), "s_nationkey")
    return G.identity_pairs(s, "n", ["s_nationkey"], "t").select("pair_id", "left", "right")


@query("with recursive e as (select distinct o_custkey as p, (o_custkey * 3 + o_orderkey % 5) % 1500 as c from orders where o_custkey <> (o_custkey * 3 + o_orderkey % 5) % 1500), r as (select p as node, 0 as hops from (select distinct p from e) where p not in (select c from e) union select c, hops + 1 from r join e on e.p = r.node where hops < 4) select node, min(hops)::int as hops from r group by node")
def reference_hops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p"), ((F.col("o_custkey") * 3 + F.col("o_orderkey") % 5) % 1500).alias("c"))
    return G.hops(o, "p", "c", 4).select("node", "hops")


@query(
    """with q as (select conv_id, turn, role as lang, (turn % 3)::int as question from conversations), l as (select *, row_number() over (partition by conv_id, lang, question order by turn) as i, min(turn) over (partition by conv_id, lang, question) as f from q),
t as (select *, row_number() over (partition by conv_id, lang order by i, f) as tn, min(turn) over (partition by conv_id, lang) as lf from l), r as (select *, row_number() over (partition by conv_id order by tn, case lang when 'assistant' then 0 else 1 end, lf, turn) as rn from t) select conv_id, turn, lang, question from r where rn <= 3"""
)
def query_balance(spark, sf_dir):
    """Three turns of each conversation, roles taking turns (standing for languages), and questions within them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("lang"), (F.col("turn") % 3).cast("int").alias("question"))
    return Q.balanced(c, ["conv_id"], "turn", "lang", "question", 3, ("assistant",))


@query("with q as (select distinct source, doc_id % 4 as question from documents), l as (select distinct source, lang from documents), c as (select distinct source, doc_id % 4 as question, lang from documents where doc_id % 3 = 0) select q.source, q.question, l.lang from q join l using (source) anti join c on c.source = q.source and c.question = q.question and c.lang = l.lang")
def language_completion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 4).alias("question"), "lang", "doc_id")
    return Q.completion(d, d, d.where("doc_id % 3 = 0"), ["source"], "question", "lang")


@query("select source, min(doc_id) as doc_id from documents group by source")
def first_of_each(spark, sf_dir):
    return Q.distinct_in_order(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("select conv_id, turn, ((row_number() over (partition by conv_id order by turn) - 1) // 2)::int as part from conversations")
def review_partitions(spark, sf_dir):
    return Q.partitions(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 2)


@query("with g as (select doc_id, count(*) as n from labels where doc_id % 5 <> 1 group by doc_id) select coalesce(d.doc_id, g.doc_id) as doc_id, case when g.n is null then 'missing' when d.doc_id is null then 'unexpected' else 'repeated' end as reason from (select doc_id from documents where doc_id % 2 = 0) d full join g on d.doc_id = g.doc_id where g.n is null or d.doc_id is null or g.n > 1")
def coverage_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id")
    return Q.bijection_violations(d, table(spark, sf_dir, "labels").where("doc_id % 5 <> 1").select("doc_id"), ["doc_id"])


@query("select page_id, 'cites ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' at ' || url as query from pages")
def cited_by_queries(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return Q.cited_by(p, "page_id", "cites {title} at {url}", {"title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "url": F.col("url")})


@query("with p as (select doc_id, text, substr(text, 1, 3) as surface from documents where length(text) > 20), f as (select *, instr(text, surface) as a from p), g as (select *, instr(substr(text, a + 3), surface) as b from f) select doc_id, (case when b = 0 then -1 else a + 2 + b - 1 end)::int as start, case when b = 0 then 'not_found' when doc_id % 10 = 0 then 'held' else 'admitted' end as status from g where not regexp_matches(surface, '[^A-Za-z]')")
def semantic_mentions(spark, sf_dir):
    """The second occurrence of each text's first three letters, as a proposed mention."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 20)
    p = d.select(F.col("doc_id").alias("document_id"), F.lit("m").alias("key"), F.substring("text", 1, 3).alias("surface"), F.lit(1).alias("occurrence"), F.when(F.col("doc_id") % 10 == 0, 0.5).otherwise(0.95).alias("confidence"), "text").where(~F.col("surface").rlike("[^A-Za-z]"))
    out = G.mentions(p, "text", 0.9)
    return out.select(F.col("document_id").alias("doc_id"), F.coalesce("start", F.lit(-1)).alias("start"), "status")
