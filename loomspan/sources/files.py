"""Local files, journals, document media and word boxes as tables."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of recognised words in tab-separated form, as the usual recogniser writes them.
WORD_BOXES = "level int, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"


def local_seeds(spark: SparkSession, expected: DataFrame, root: str, most_bytes: int) -> DataFrame:
    """expected (path, sha256, mime) with status: read, missing, too_large, outside or changed; content of what was read.

    One read of the files under root; paths that leave it are refused before.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    found = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("_p"), "length", "content")
    want = expected.withColumn("_p", F.concat(F.lit(base + "/"), "path")).withColumn("_out", F.startswith("path", F.lit("/")) | F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    met = want.join(found, "_p", "left")
    status = F.when(F.col("_out"), "outside").when(F.col("length").isNull(), "missing").when(F.col("length") > most_bytes, "too_large").when(F.sha2("content", 256) != F.lower("sha256"), "changed").otherwise("read")
    out = met.withColumn("status", status)
    return out.select(*expected.columns, "status", F.when(F.col("status") == "read", F.col("content")).alias("content"))


def write_journal(log: DataFrame, path: str, run: str, seq: str) -> None:
    """Appends entries as JSON lines, in order within each run."""
    log.repartition(run).sortWithinPartitions(run, seq).write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: str, run: str, seq: str) -> DataFrame:
    """Entries of a journal up to the first broken line of each run; lines that are no entry at all are left out.

    Schemas are given, never inferred.
    """
    raw = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    torn = F.sum(F.when(F.col("_broken").isNull(), 0).otherwise(1)).over(W.partitionBy(run).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return raw.where(F.col(run).isNotNull()).withColumn("_t", torn).where("_t = 0").drop("_t", "_broken")


def media(declared: Column, content: Column, generic=("application/octet-stream", "binary/octet-stream")) -> Column:
    """pdf or docx by the declared type, or by the first bytes where the declared type says nothing; else null."""
    kind = F.lower(F.trim(F.split(declared, ";")[0]))
    head = F.substring(content, 1, 5)
    loose = kind.isin(*generic) | declared.isNull()
    return (
        F.when((kind == "application/pdf") | (loose & (head == F.lit(b"%PDF-"))), "pdf")
        .when(kind == "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx")
    )


_DECLARATION = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)


def archive_reason(raw: bytes | None, most_entries: int = 2000, most_bytes: int = 256 << 20, ratio: int = 200) -> str | None:
    """Why a word-processor archive is refused; None if it is admitted."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            items = z.infolist()
            names = [i.filename for i in items]
            if len(items) > most_entries:
                return "entries"
            if len(set(names)) != len(names):
                return "repeated_name"
            if any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names):
                return "unsafe_name"
            if any(i.flag_bits & 1 for i in items):
                return "encrypted"
            if any(i.external_attr >> 28 == 0xA for i in items):
                return "link"
            if sum(i.file_size for i in items) > most_bytes or any(i.file_size > ratio * max(1, i.compress_size) for i in items):
                return "expansion"
            if any(_DECLARATION.search(z.read(i)) for i in items if i.filename.endswith((".xml", ".rels"))):
                return "declaration"
            return None if {"word/document.xml", "[Content_Types].xml"} <= set(names) else "no_document"
    except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, NotImplementedError):
        return "no_archive"


@F.pandas_udf(T.StringType())
def docx_refusal(raw: pd.Series) -> pd.Series:
    return raw.map(archive_reason)


def word_boxes(readings: DataFrame, key: str, tsv: str, width: str, height: str, least_confidence: float) -> DataFrame:
    """key, ordinal, text, confidence and the box as shares of the page, of recognised words that are sure enough."""
    fields = F.transform(F.split(tsv, "\n"), lambda r: F.from_csv(r, WORD_BOXES, {"sep": "\t", "quote": ""}))
    out = readings.select(F.col(key).alias(key), F.col(width).alias("_pw"), F.col(height).alias("_ph"), F.posexplode(fields).alias("ordinal", "_b"))
    out = out.where("_b.level = 5 and _b.width > 0 and _b.height > 0").where((F.col("_b.conf") >= least_confidence) & (F.trim("_b.text") != ""))
    share = lambda a, of: F.round(a / F.col(of), 6)
    return out.select(
        key, "ordinal", F.col("_b.text").alias("text"), F.col("_b.conf").alias("confidence"), share(F.col("_b.left"), "_pw").alias("left"), share(F.col("_b.top"), "_ph").alias("top"),
        share(F.col("_b.left") + F.col("_b.width"), "_pw").alias("right"), share(F.col("_b.top") + F.col("_b.height"), "_ph").alias("bottom"),
    )


def figure_boxes(figures: DataFrame, terms: list[str]) -> DataFrame:
    """figures (caption, regions array<struct<page,left,top,right,bottom,origin>>, page_width, page_height) and status.

    A figure is admitted if its caption names a term and it has one region; the region is given from the top left, as shares.
    """
    low = F.lower(F.coalesce("caption", F.lit("")))
    hit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))
    status = F.when(~hit, "caption").when(F.size("regions") != 1, "regions").otherwise("admitted")
    r = F.get("regions", F.lit(0))
    flip = r["origin"] == "BOTTOMLEFT"
    top, bottom = F.when(flip, F.col("page_height") - r["top"]).otherwise(r["top"]), F.when(flip, F.col("page_height") - r["bottom"]).otherwise(r["bottom"])
    box = F.struct((r["left"] / F.col("page_width")).alias("left"), (F.least(top, bottom) / F.col("page_height")).alias("top"), (r["right"] / F.col("page_width")).alias("right"), (F.greatest(top, bottom) / F.col("page_height")).alias("bottom"))
    return figures.withColumn("status", status).withColumn("box", F.when(F.col("status") == "admitted", box))


def onion_search(responses: DataFrame, key: str, raw: str, now: Column, oldest_seconds: int, most_chars: int, valid_host) -> DataFrame:
    """key, ordinal, url, title, snippet of an index's hits; nothing of an answer that is partial or timed out.

    Hits that are banned, not on a valid onion host, or observed in the future or too long ago are left out.
    """
    shape = "timed_out boolean, _shards struct<failed:int>, hits struct<hits:array<struct<_source:struct<url:string,title:string,meta:string,content:string,is_banned:boolean,updated_on:double>>>>"
    got = responses.select(key, F.from_json(raw, shape).alias("r")).where("not r.timed_out and r._shards.failed = 0")
    hit = got.select(key, F.posexplode("r.hits.hits").alias("ordinal", "h")).select(key, "ordinal", "h._source.*")
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]*)", 1))
    fresh = F.col("updated_on").between(now - oldest_seconds, now)
    text = F.when(F.length(F.trim("meta")) > 0, F.col("meta")).otherwise(F.col("content"))
    return hit.where(~F.coalesce("is_banned", F.lit(False)) & fresh & valid_host(host)).select(key, "ordinal", "url", "title", F.substring(text, 1, most_chars).alias("snippet"))
