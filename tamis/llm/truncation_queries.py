"""Queries of the cut-text problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.truncation import cut_texts
from tamis.session import table


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang", "announced_bytes")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).where("cut").select("doc_id")


def p9_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts."""
    return _cut(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_source_report": p9_source_report}
ORACLE: dict[str, str] = {}
