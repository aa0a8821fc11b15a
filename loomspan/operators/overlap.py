"""Which documents hold a stretch of an item's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import char_grams


def stretch_overlap(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, chars: int) -> DataFrame:
    """doc, item: documents that hold one of the item's stretches of so many characters (cut from its start, one after the other).

    Blanks are collapsed and cases folded. Stretches meet by the hash of the characters; hits are compared in full.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    b = items.select(F.col(item).alias("item_id"), flat(F.col(item_text)).alias("_t")).where(F.length("_t") >= chars)
    b = b.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.length("_t") / chars).cast("int") - 1), lambda i: F.substring("_t", i * chars + 1, F.lit(chars)))).alias("_s")).distinct()
    b = b.withColumn("_g", F.xxhash64("_s"))
    d = docs.select(F.col(doc).alias("doc_id"), flat(F.col(text)).alias("_t")).where("_t is not null")
    found = char_grams(d, "doc_id", "_t", chars, b.select("_g", "_s"))
    return found.join(b, (found["_g"] == b["_g"]) & (found["_gram"] == b["_s"])).select("doc_id", "item_id").distinct()
