"""Queries of the varied-subset problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.words import word_text
from tamis.llm.diverse import members, varied_subset
from tamis.llm.records import params
from tamis.session import materialize, table

_KINDS = ["structure_key", "hardness_key"]


def _chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    candidates = materialize(members(table(spark, sf_dir, "request_meta"), "exemplars"), "members")
    return varied_subset(candidates, int(params(spark, sf_dir)["p4_subset_size"])), candidates


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir)[0].select("structure", "hardness", "sql", "occurrences")


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each structure and level: members, different statements, and how many the subset holds."""
    chosen, candidates = _chosen(spark, sf_dir)
    held = chosen.groupBy(*_KINDS).agg(F.count("*").alias("chosen"))
    every = candidates.groupBy(*_KINDS).agg(F.sum("occurrences").alias("members"), F.count("*").alias("statements"))
    return every.join(held, _KINDS, "left").select(F.col("structure_key").alias("structure"), F.col("hardness_key").alias("hardness"), "members", "statements", F.coalesce("chosen", F.lit(0)).cast("bigint").alias("chosen"))


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what must hold of the subset, counted."""
    chosen, candidates = _chosen(spark, sf_dir)
    chosen = materialize(chosen, "subset")
    kinds = candidates.where("structure_key != ''").select("structure_key").distinct().join(chosen.select("structure_key").distinct(), "structure_key", "left_anti")
    of = chosen.agg(F.count("*").alias("chosen"), F.countDistinct(word_text(F.col("sql"))).alias("statements"), F.count_if(word_text(F.col("sql")) == "").alias("blank"))
    foreign = chosen.join(candidates.select("key"), "key", "left_anti").agg(F.count("*").alias("foreign"))
    missed = kinds.agg(F.count("*").alias("missed_structures"))
    return of.crossJoin(F.broadcast(foreign)).crossJoin(F.broadcast(missed))  # of one row each


QUERIES = {"p4_subset": p4_subset, "p4_coverage": p4_coverage, "p4_invariants": p4_invariants}

_STATEMENTS = """(SELECT count(DISTINCT w) FROM (SELECT array_to_string(regexp_extract_all(strip_accents(lower(e.sql)), '[a-z0-9]+'), ' ') AS w FROM (SELECT unnest(exemplars) AS e FROM request_meta)) WHERE w <> '')"""
ORACLE = {
    "p4_invariants": f"SELECT n AS chosen, n AS statements, 0::BIGINT AS blank, 0::BIGINT AS foreign, 0::BIGINT AS missed_structures FROM (SELECT least({_STATEMENTS}, (SELECT val FROM run_params WHERE param = 'p4_subset_size'))::BIGINT AS n)",
}
