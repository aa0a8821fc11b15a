"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, lines, mixing, neardup, pii, quality, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(_table(spark, sf_dir, "documents"))


def op2_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("found")


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.cube_mix(_table(spark, sf_dir, "documents"))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.winnow_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))

def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The key of the registered query; a user of the operator passes one of their own.
PII_KEY = "loomspan-demo-key"


def op10_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_redirects, op3_licenses, op4_setsketch, op5_line_dedup, op6_language, op7_cube_mix, op8_winnow, op9_toxicity, op10_feistel)}
ORACLE_SQL = {"op2_redirects": urls.OP2_SQL, "op4_setsketch": neardup.OP4_SQL, "op5_line_dedup": lines.OP5_SQL, "op8_winnow": decontaminate.OP8_SQL}
