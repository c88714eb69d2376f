"""Queries of the packing problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.packing import packed
from tamis.llm.records import params
from tamis.session import materialize, table


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = int(params(spark, sf_dir)["p7_capacity_tokens"])
    return packed(table(spark, sf_dir, "documents"), "doc_id", "text", capacity).withColumnRenamed("key", "doc_id")


def p7_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins used beside the fewest possible, and the share of space filled."""
    capacity = int(params(spark, sf_dir)["p7_capacity_tokens"])
    bins = p7_bins(spark, sf_dir).groupBy("bin_id").agg(F.sum("tokens").alias("filled"))
    return bins.agg(F.count("*").alias("bins"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest")).withColumn("fewest", F.ceil(F.col("tokens") / capacity)).withColumn("share", F.col("tokens") / (F.col("bins") * capacity))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents placed, pieces placed twice, bins beyond the capacity, documents split without need, and split ones with a gap."""
    capacity = int(params(spark, sf_dir)["p7_capacity_tokens"])
    bins = materialize(p7_bins(spark, sf_dir), "bins")
    of = bins.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece").alias("different"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.max("piece").alias("last"))
    told = of.agg(
        F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.col("different")).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("needless"),
        F.count_if((F.col("end") != F.col("tokens")) | (F.col("last") + 1 != F.col("different"))).alias("gaps"),
    )
    over = bins.groupBy("bin_id").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("overfull"))
    return told.crossJoin(F.broadcast(over))  # of one row


QUERIES = {"p7_bins": p7_bins, "p7_fill_report": p7_fill_report, "p7_invariants": p7_invariants}
ORACLE = {"p7_invariants": "SELECT count(*) AS documents, 0::BIGINT AS twice, 0::BIGINT AS needless, 0::BIGINT AS gaps, 0::BIGINT AS overfull FROM documents"}
