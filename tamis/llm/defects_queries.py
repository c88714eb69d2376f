"""Queries of the broken-pair problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.defects import broken_pairs
from tamis.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "d_retry_corrected"), "rec_id", "question", "sql", "schema")


def p5_defects_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many defective pairs each verdict of the judge let through."""
    verdicts = table(spark, sf_dir, "d_retry_corrected").select("rec_id", F.coalesce(F.lower("verdict"), F.lit("")).alias("verdict"))
    return p5_found(spark, sf_dir).join(verdicts, "rec_id").groupBy("verdict", "defect").agg(F.count("*").alias("records"))


QUERIES = {"p5_found": p5_found, "p5_defects_by_verdict": p5_defects_by_verdict}
ORACLE: dict[str, str] = {}
