"""URL filter with redirect equivalence: rules by host and path, and block decisions that reach all aliases of a url.

Aliases are the connected components over redirect and canonical-link edges.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .graph import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts whose rules are sent to every task; beyond it they are joined.
BROADCAST_HOSTS = 50_000
_LINK = r"""<link[^>]*rel=["']?canonical["']?[^>]*>"""
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_REFRESH = r"""<meta[^>]*http-equiv=["']?refresh["']?[^>]*>"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What two spellings of a node share: host, path and query; scheme and fragment don't tell urls apart. Null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.regexp_extract(url, r"://[^/?#]*[^?#]*(\?[^#]*)", 1)))


def resolved(src: str | None, base: str | None, link: str) -> str | None:
    """A link's target, its entities decoded, against the page's base or url; None if there is no address to go from."""
    link = html.unescape(link).strip()
    if not link or _SCHEME.match(link):
        return link or None
    if base:
        src = resolved(src, None, base)
    scheme, found, rest = (src or "").partition("://")
    if not found:
        return None
    # Joined as http, since not all schemes can be joined.
    try:
        return scheme + urljoin(f"http://{rest}", link)[4:]
    except ValueError:
        return f"{scheme}://{re.split('[/?#]', rest)[0]}{link}" if link.startswith("/") and not link.startswith("//") else None


@F.pandas_udf(T.StringType())
def _resolved(src: pd.Series, base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([resolved(s, b, x) for s, b, x in zip(src, base, link)], dtype=object)


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst: what pages say of themselves by all their canonical links and refresh redirects, resolved against <base> or their url."""
    low = F.translate(F.col(html_col), _UPPER, _LOWER)
    found = pages.where(F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))).select(F.col(url_col).alias("src"), F.col(html_col).alias("_h"))
    targets = lambda tag, attr: F.transform(F.regexp_extract_all("_h", F.lit(f"(?i)({tag})"), F.lit(1)), lambda t: F.regexp_extract(t, rf"""(?i){attr}=["']?([^"'\s>]+)""", 1))
    base = F.regexp_extract("_h", r"""(?i)<base\s[^>]*?href=["']?([^"'\s>]+)""", 1)
    to = found.select("src", base.alias("_base"), F.explode(F.array_distinct(F.concat(targets(_LINK, "href"), targets(_REFRESH, "url")))).alias("_to")).where("_to <> ''")
    return to.select("src", _resolved("src", "_base", "_to").alias("dst")).where("dst is not null")


def rule_table(spark, rules) -> DataFrame:
    """action, host, path of each rule, as a table."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("action"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for a, h, p in rules))))


def _ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with _host, _path) and _rule: action and text of the longest rule that fits.

    Rules are looked up once for each host, by its suffixes; a row then reads the rules of its host only.
    """
    hosts = rows.select(F.col("_host").alias("_h")).where("_h <> ''").distinct()
    labels = F.split("_h", r"\.", -1)
    suffixes = hosts.select("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    fit = suffixes.join(rules, "rule_host").select("_h", F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("o"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", F.col("action").alias("action")).alias("_r"))
    of = fit.groupBy("_h").agg(F.sort_array(F.collect_set("_r")).alias("_rs"))
    # Hosts repeat; their rules are sent to all tasks up to a checked number, else a popular host is Spark's to split.
    of = stored(of, "host-rules")
    out = rows.join(F.broadcast(of) if of.count() <= BROADCAST_HOSTS else of, rows["_host"] == of["_h"], "left").drop("_h")
    return out.withColumn("_rule", F.get(F.filter("_rs", lambda r: F.startswith("_path", r["rule_path"])), F.lit(0))).drop("_rs")


def url_verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of pages: id, host, path, rule (of the longest that fits, or null), verdict, alias_of.

    edges (src, dst) are known redirects; canonical links and refreshes of the pages' own html are added. A url's own
    rule decides for it. Otherwise its aliases do: an explicit allow of one of them comes before a block, and a url
    without either is allowed. rules is a sequence of (action, host, path) or such a table; of two rules with the same
    text, allow wins. Null urls, and those without ://, have no host, fit no rule and have no alias. Loops, repeated
    edges, repeated pages and empty tables are fine; alias_of is the least key of the url's component, null if it has no edge.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"), alias_key(url).alias("_key"))
    rows = _ruled(rows, table)
    links = html_edges(pages.select(url_col, html_col), url_col, html_col) if html_col else None
    if edges is not None:
        own = edges.select("src", "dst")
        links = own if links is None else links.union(own)
    if links is None:
        raise ValueError("no edges: give a table of redirects or the pages' html")
    keyed = stored(links.select(alias_key(F.col("src")).alias("a"), host_of(F.col("src")).alias("ah"), path_of(F.col("src")).alias("ap"), alias_key(F.col("dst")).alias("b"), host_of(F.col("dst")).alias("bh"), path_of(F.col("dst")).alias("bp")).where("a <> b").distinct(), "url-edges")
    groups = connected_components(keyed, "a", "b").select(F.col("node").alias("_node"), "component")
    # The rules of all urls that edges name, pages or not, decide for their component.
    named = keyed.select(F.col("a").alias("_key"), F.col("ah").alias("_host"), F.col("ap").alias("_path")).union(keyed.select("b", "bh", "bp")).distinct()
    ruled = _ruled(named, table).join(groups, F.col("_key") == F.col("_node"))
    says = ruled.groupBy("component").agg(F.bool_or(F.coalesce(F.col("_rule.action") == "allow", F.lit(False))).alias("_allow"), F.bool_or(F.coalesce(F.col("_rule.action") == "block", F.lit(False))).alias("_block"))
    decided = groups.join(says, "component")
    out = rows.join(decided, rows["_key"] == decided["_node"], "left")
    by_alias = F.when(F.coalesce("_allow", F.lit(False)), "allow").when(F.coalesce("_block", F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", by_alias).alias("verdict"), F.col("component").alias("alias_of"))


def _sql() -> str:
    def key(x: str) -> tuple[str, str, str]:
        host = f"translate(coalesce(regexp_extract({x}, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
        path = f"coalesce(regexp_extract({x}, '://[^/?#]*([^?#]*)', 1), '')"
        return host, path, f"case when {host} <> '' then {host} || {path} || regexp_extract({x}, '://[^/?#]*[^?#]*(\\?[^#]*)', 1) end"

    def best(h: str, p: str, what: str) -> str:
        return f"(select arg_max({what}, length(rh || rp)) from rules where ({h} = rh or ends_with({h}, '.' || rh)) and starts_with({p}, rp))"

    def q(s: str) -> str:
        return s.replace("'", "''")

    h, p, k = key("url")
    sh, sp, sk = key("src")
    dh, dp, dk = key("dst")
    rules = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES)
    attr = q(r"""["']?([^"'\s>]+)""")
    return f"""
with recursive rules(action, rh, rp) as (values {rules}),
f as (select url as src, unnest([regexp_extract(regexp_extract(html, '(?i)({q(_LINK)})', 1), '(?i)href={attr}', 1), regexp_extract(regexp_extract(html, '(?i)({q(_REFRESH)})', 1), '(?i)url={attr}', 1)]) as t from pages where html is not null),
l as (select src, case when contains(t, '://') then t when starts_with(t, '//') then regexp_extract(src, '^(.*?)://', 1) || ':' || t when starts_with(t, '/') then regexp_extract(src, '^(.*?)://', 1) || '://' || {sh} || t end as dst from f where t <> ''),
e as (select distinct {sk} as a, {sh} as ah, {sp} as ap, {dk} as b, {dh} as bh, {dp} as bp from l where dst is not null and {sk} <> {dk}),
n as (select a as k, ah as h, ap as p from e union select b, bh, bp from e),
w as (select a as x, b as y from e union select b, a from e),
r as (select x as node, x as seen from w union select r.node, w.y from r join w on r.seen = w.x),
c as (select node, min(seen) as component from r group by node),
s as (select component, bool_or(coalesce({best('h', 'p', 'action')} = 'allow', false)) as al, bool_or(coalesce({best('h', 'p', 'action')} = 'block', false)) as bl from n join c on c.node = n.k group by component),
u as (select page_id, {h} as host, {p} as path, {k} as k from pages)
select page_id, host, path, {best('host', 'path', 'rh || rp')} as rule, coalesce({best('host', 'path', 'action')}, case when al then 'allow' when bl then 'block' else 'allow' end) as verdict, c.component as alias_of
from u left join c on c.node = u.k left join s on s.component = c.component
"""


#: DuckDB SQL of the op2 query.
OP2_SQL = _sql()
