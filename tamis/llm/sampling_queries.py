"""Queries of the proportional-sample problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.records import NAMED_SQL, hardness_key, name_tokens_sql, own_or_from_id, params, with_database
from tamis.llm.sampling import proportional_sample, quotas, reservoirs, target_report
from tamis.session import materialize, table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    records = table(spark, sf_dir, "d_retry_corrected").select("rec_id", "id", "db_id", "hardness")
    known = with_database(records, table(spark, sf_dir, "db_catalogue")).select("rec_id", "id", hardness_key(own_or_from_id(F.col("hardness"), 2)).alias("level"), "db")
    targets = table(spark, sf_dir, "sample_targets").select(F.col("target_id").alias("target"), F.col("hardness").alias("level"), F.col("db_id").alias("db"), "target_share", "min_rows")
    size = int(params(spark, sf_dir)["p6_sample_size"])
    return known, quotas(targets, size), size


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, wanted, _ = _inputs(spark, sf_dir)
    return target_report(reservoirs(known, wanted, ["level", "db"], "id", "rec_id"), wanted)


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known, wanted, size = _inputs(spark, sf_dir)
    return proportional_sample(known, wanted, ["level", "db"], "id", "rec_id", size)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).where("missing > 0").select(F.col("target").alias("target_id"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[0].select(F.col("target").alias("target_id"), F.col("rec").alias("rec_id"), F.col("who").alias("id"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be had of each quota asked for."""
    return _report(spark, sf_dir).withColumnRenamed("target", "target_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sample holds of each target and the share that makes."""
    return _sample(spark, sf_dir)[1].withColumnRenamed("target", "target_id")


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the sample's records, different ids, records of another target's category, and targets below their minimum that needn't be."""
    known, wanted, size = _inputs(spark, sf_dir)
    sample, shares = proportional_sample(known, wanted, ["level", "db"], "id", "rec_id", size)
    sample = materialize(sample.select("target", "who", "rec"), "sample")
    truly = known.select("rec_id", F.col("level").alias("_level"), F.col("db").alias("_db"))
    strange = sample.join(wanted.select("target", "level", "db"), "target").join(truly, F.col("rec") == F.col("rec_id")).where("level != _level OR db != _db").agg(F.count("*").alias("strange"))
    held = known.join(wanted.select("target", "level", "db", "min_rows"), ["level", "db"]).groupBy("target", "min_rows").agg(F.countDistinct("id").alias("n"))
    below = held.join(shares.select("target", "drawn"), "target").where("drawn < least(min_rows, n)").agg(F.count("*").alias("below_minimum"))
    return sample.agg(F.count("*").alias("records"), F.countDistinct("who").alias("ids")).crossJoin(F.broadcast(strange)).crossJoin(F.broadcast(below))  # of one row each


QUERIES = {"p6_invariants": p6_invariants, "p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report, "p6_shares": p6_shares}

_COUNTS = f"""WITH c AS (SELECT {name_tokens_sql('db_id')} AS k, min(db_id) AS db FROM db_catalogue GROUP BY 1),
r AS (SELECT id, regexp_extract(lower(CASE WHEN trim(coalesce(hardness, '')) = '' THEN split_part(id, ':', 3) ELSE hardness END), '[a-z]+') AS level, {name_tokens_sql(NAMED_SQL)} AS k FROM d_retry_corrected),
n AS (SELECT level, db, count(DISTINCT id) AS n FROM r JOIN c USING (k) GROUP BY ALL),
q AS (SELECT t.target_id, greatest(min_rows, floor(target_share * (SELECT val FROM run_params WHERE param = 'p6_sample_size') + 0.5 + 1e-9))::INT AS quota, coalesce(n, 0) AS n
  FROM sample_targets t LEFT JOIN n ON n.level = t.hardness AND n.db = t.db_id)
"""
ORACLE = {
    "p6_found": _COUNTS + "SELECT target_id FROM q WHERE n < quota",
    "p6_report": _COUNTS + "SELECT target_id, quota, least(n, quota)::BIGINT AS drawn, greatest(quota - n, 0)::BIGINT AS missing FROM q",
    "p6_invariants": _COUNTS + "SELECT r AS records, r AS ids, 0::BIGINT AS strange, 0::BIGINT AS below_minimum FROM (SELECT least(sum(n), (SELECT val FROM run_params WHERE param = 'p6_sample_size'))::BIGINT AS r FROM q)",
}
