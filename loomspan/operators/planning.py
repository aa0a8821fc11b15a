"""Search plans: balanced cuts, completion by language, expansion, and records that must cover each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def balanced(queries: DataFrame, plan: list[str], seq: str, lang: str, question: str, bound: int, preferred=()) -> DataFrame:
    """The first bound queries of each plan, in their own order, after languages take turns and, in a language, its questions.

    Languages come in the preferred order, others by first appearance, and so do questions.
    """
    by = lambda *c: W.partitionBy(*plan, *c)
    # A query's place in its lane, lanes of a language by their first query, then the turn of each language.
    lane = queries.withColumn("_i", F.row_number().over(by(lang, question).orderBy(seq))).withColumn("_q", F.min(seq).over(by(lang, question)))
    turn = lane.withColumn("_t", F.row_number().over(by(lang).orderBy("_i", "_q")))
    want = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        want = F.when(F.col(lang) == p, i).otherwise(want)
    first = turn.withColumn("_l", F.min(seq).over(by(lang))).withColumn("_w", want)
    order = first.withColumn("_r", F.row_number().over(by().orderBy("_t", "_w", "_l", seq)))
    return order.where(f"_r <= {bound}").select(*queries.columns)


def completion(questions: DataFrame, languages: DataFrame, covered: DataFrame, plan: list[str], question: str, lang: str) -> DataFrame:
    """Pairs of a plan's questions and languages that no query covers. Both lists belong to one plan and are short."""
    grid = questions.select(*plan, question).distinct().join(languages.select(*plan, lang).distinct(), plan)
    return grid.join(covered.select(*plan, question, lang).distinct(), [*plan, question, lang], "left_anti")


def distinct_in_order(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key."""
    best = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), seq).alias("r"))
    return best.select("r.*")


def new_rows(after: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    return after.join(before.select(*key).distinct(), key, "left_anti")


def bijection_violations(expected: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """key and reason: missing, unexpected or repeated."""
    g = given.groupBy(*key).agg(F.count("*").alias("_n"))
    e = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    both = e.join(g, key, "full_outer")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return both.withColumn("reason", reason).where("reason is not null").select(*key, "reason")


def answer_violations(answers: DataFrame, reviews: DataFrame, answer: str, claims: str, least: float) -> DataFrame:
    """answer and reason: reviews must name the claims 0 to n - 1 once each, all be supported, and be sure enough."""
    r = reviews.groupBy(F.col(answer).alias("_a")).agg(F.count("*").alias("n"), F.count_distinct("claim").alias("k"), F.min("claim").alias("lo"), F.max("claim").alias("hi"), F.bool_and(F.col("verdict") == "supported").alias("ok"), F.min("confidence").alias("c"))
    met = answers.join(r, answers[answer] == r["_a"], "left")
    full = (F.col("n") == F.col(claims)) & (F.col("k") == F.col(claims)) & (F.col("lo") == 0) & (F.col("hi") == F.col(claims) - 1)
    reason = F.when(~F.coalesce(full, F.lit(False)), "coverage").when(~F.col("ok"), "unsupported").when(F.col("c") < least, "confidence")
    return met.withColumn("reason", reason).where("reason is not null").select(answer, "reason")


def cited_by(documents: DataFrame, doc: str, template: str, fields: dict[str, Column]) -> DataFrame:
    """doc and query: a search for what cites each document, by a template with {names}."""
    text = F.lit(template)
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return documents.select(doc, text.alias("query")).where(F.trim("query") != "")


def top_per_parent(hits: DataFrame, parent: str, score: str, ordinal: str, most: int) -> DataFrame:
    return hits.withColumn("_r", F.row_number().over(W.partitionBy(parent).orderBy(F.desc(score), ordinal))).where(f"_r <= {most}").drop("_r")


def partitions(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """rows and part: slices of so many rows in order."""
    return rows.withColumn("part", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1) / size).cast("int"))
