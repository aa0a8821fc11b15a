"""Admission filters: hosts, references, links, leads and readings, with one reason for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = ("direct", "supporting", "background", "unjudged")


def first_hosts(rows: DataFrame, host: str, seq: str, most: int) -> DataFrame:
    """Rows whose host is among the first so many distinct hosts in order of arrival. Hosts are ranked, not rows."""
    firsts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_h")).agg(F.min(seq).alias("_s")).orderBy("_s", "_h").limit(most)
    return rows.join(firsts, rows[host] == firsts["_h"], "left_semi")


def source_policy(rows: DataFrame, host: str, seq: str, denied=(), configured=None, most_hosts: int | None = None) -> DataFrame:
    """Rows that a source policy admits: not denied, only configured hosts if so asked, and no more distinct hosts than the cap."""
    out = rows.where(~F.col(host).isin(*denied)) if denied else rows
    out = out.where(F.col(host).isin(*configured)) if configured is not None else out
    return first_hosts(out, host, seq, most_hosts) if most_hosts is not None else out


def ranked_links(links: DataFrame, page: str, ordinal: str, score: str, most: int, least: float, drop: DataFrame | None = None, target: str = "target") -> DataFrame:
    """The first most links of each page by score (then order), and of these the ones that score enough and are not among drop. Skipped ones are not filled up."""
    w = W.partitionBy(page).orderBy(F.desc(score), ordinal)
    out = links.withColumn("_r", F.row_number().over(w)).where(f"_r <= {most}").where(F.col(score) >= least).drop("_r")
    return out.join(drop, target, "left_anti") if drop is not None else out


def references(rows: DataFrame, parent: str, seq: str, score: str, hops: str, in_scope: Column, seen: Column, max_hops: int, least: float, per_parent: int, total: int) -> DataFrame:
    """rows and decision: hop_limit, below_score, already_seen, out_of_scope, budget_limit or queued, in this order.

    A target that was asked for before, by the same rows, is seen. Caps count only rows that pass the other tests, in order.
    """
    early = F.when(F.col(hops) > max_hops, "hop_limit").when(F.col(score) < least, "below_score").when(seen, "already_seen").when(~in_scope, "out_of_scope")
    out = rows.withColumn("_early", early)
    free = F.when(F.col("_early").isNull(), 1).otherwise(0)
    out = out.withColumn("_p", F.sum(free).over(W.partitionBy(parent).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)))
    # The run-wide cap is a sum over all rows in order: rows that still compete are few, and are ranked by themselves.
    open_ = out.where("_early is null").where(F.col("_p") <= per_parent).orderBy(seq).limit(total).select(F.col(seq).alias("_q"))
    out = out.join(open_, out[seq] == open_["_q"], "left")
    return out.withColumn("decision", F.coalesce("_early", F.when(F.col("_q").isNull(), "budget_limit"), F.lit("queued"))).drop("_early", "_p", "_q")


def grade(relevance: Column, decision: Column) -> Column:
    """The given relevance; else by the decision: rejected is unrelated, accepted is supporting, anything else background."""
    return F.coalesce(relevance, F.when(decision == "reject", "unrelated").when(decision == "accept", "supporting").otherwise("background"))


def disposition(decision: Column, relevance: Column, omitted: Column, second_look: Column, cosine: Column, floor: float = 0.8) -> Column:
    """struct<action, grade, reason> of a reading.

    A rejection with text left out is looked at again once; a hold after that is kept if its cosine reaches the floor.
    """
    g = grade(relevance, decision)
    again = (decision != "accept") & (omitted > 0) & ~second_look
    close = (decision == "hold") & F.coalesce(cosine >= floor, F.lit(False))
    action = F.when(again, "look_again").when((decision == "accept") | close, "keep").otherwise("hold")
    reason = F.when(again, "omitted_text").when(decision == "accept", "accepted").when(close, "cosine_floor").when(decision == "reject", "rejected").otherwise("held")
    return F.struct(action.alias("action"), g.alias("grade"), reason.alias("reason"))


def grade_rank(g: Column) -> Column:
    out = F.when(g == GRADES[0], 0)
    for i, x in enumerate(GRADES[1:], 1):
        out = out.when(g == x, i)
    return out


def answer_order(readings: DataFrame, grade_col: str, seq: str, most: int | None = None) -> DataFrame:
    """Readings without unrelated ones, by grade and then arrival."""
    out = readings.where(grade_rank(F.col(grade_col)).isNotNull()).orderBy(grade_rank(F.col(grade_col)), seq)
    return out.limit(most) if most is not None else out


def barrier(html: Column, mime: Column) -> Column:
    """login, paywall or challenge by the first markers found in that order, in html pages only; else null."""
    low = F.lower(html)
    has = lambda *words: F.lit(False) if not words else F.coalesce(low.rlike("|".join(words)), F.lit(False))
    kind = F.when(has('type=["\']?password', "please log in", "sign in to continue"), "login").when(has("paywall", "subscribe to continue", "subscribers only"), "paywall").when(has("captcha", "cf-challenge", "verify you are human"), "challenge")
    return F.when(F.lower(mime).rlike("^(text/html|application/xhtml)"), kind)


def needs_script(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(low.rlike("enable javascript|javascript is required|requires javascript"), F.lit(False))


def domains(rows: DataFrame, host: str, allowed: DataFrame) -> DataFrame:
    """Rows whose kind of domain (onion or open_web) is in allowed.kind."""
    kind = F.when(F.endswith(F.lower(F.col(host)), F.lit(".onion")), "onion").otherwise("open_web")
    return rows.withColumn("_kind", kind).join(allowed.select(F.col("kind").alias("_kind")).distinct(), "_kind", "left_semi").drop("_kind")


def retryable(status: Column, transient=(408, 425, 429, 500, 502, 503, 504)) -> Column:
    return status.isin(*transient)


def worst_verdict(verdicts: Column) -> Column:
    """unsupported if any is, else ambiguous if any is, else supported."""
    return F.when(F.array_contains(verdicts, "unsupported"), "unsupported").when(F.array_contains(verdicts, "ambiguous"), "ambiguous").otherwise("supported")


def fetch_outcome(status: Column, mime_ok: Column, script: Column, in_scope: Column, robots_ok: Column) -> Column:
    """What follows from one route's response: out_of_scope, robots, stop (4xx), next_route, refuse, render or read."""
    return F.when(~in_scope, "out_of_scope").when(~robots_ok, "robots").when(status.between(400, 499), "stop").when((status >= 500) | status.isNull(), "next_route").when(~mime_ok, "refuse").when(script, "render").otherwise("read")


def robots_allow(rows: DataFrame, path: str, host: str, rules: DataFrame) -> DataFrame:
    """rows and allowed: the longest rule of the host (host, prefix, allow) that the path starts with; of equal ones, allow."""
    by = rules.groupBy(F.col("host").alias("_h")).agg(F.array_sort(F.collect_set(F.struct((-F.length("prefix")).alias("n"), (~F.col("allow")).alias("deny"), F.col("prefix").alias("prefix")))).alias("_rs"))
    out = rows.join(by, rows[host] == by["_h"], "left")
    first = F.get(F.filter("_rs", lambda r: F.startswith(F.col(path), r["prefix"])), F.lit(0))
    return out.withColumn("allowed", F.coalesce(~first["deny"], F.lit(True))).drop("_h", "_rs")
