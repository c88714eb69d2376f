"""Shared reading of the record tables: clean database and hardness of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.words import name_key, strict_name_key
from tamis.session import table


def params(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """run_params as a dict (six rows)."""
    return {r["param"]: r["val"] for r in table(spark, sf_dir, "run_params").limit(1000).collect()}


def own_or_from_id(column: Column, part: int) -> Column:
    """The column, or where it is blank the part of the record's id ('D:db:hardness:...')."""
    return F.coalesce(F.when(F.trim(F.regexp_replace(column, r"\s+", " ")) != "", column), F.get(F.split("id", ":"), F.lit(part)))


def hardness_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", "")


def with_database(records: DataFrame, catalogue: DataFrame, name: str = "db") -> DataFrame:
    """Adds the database a record concerns, in the catalogue's spelling.

    It is the one db_id names, or, if that is blank or names none of the catalogue, the one the id names; a name the
    catalogue lacks altogether keeps its key as its spelling. Where the catalogue has names that differ only in leading
    zeros, the one written as in the record comes first.
    """
    spelled = catalogue.where("db_id IS NOT NULL").select(name_key(F.col("db_id")).alias("_k"), F.struct(strict_name_key(F.col("db_id")).alias("s"), F.col("db_id").alias("d")).alias("_n"))
    known = spelled.groupBy("_k").agg(F.array_sort(F.collect_set("_n")).alias("_n"))  # one database's spellings
    own, told = own_or_from_id(F.col("db_id"), 1), F.get(F.split("id", ":"), F.lit(1))
    keyed = records.withColumns({"_own": name_key(own), "_strict": strict_name_key(own), "_told": name_key(told)})
    joined = keyed.join(known.select(F.col("_k").alias("_own"), F.col("_n").alias("_a")), "_own", "left").join(known.select(F.col("_k").alias("_told"), F.col("_n").alias("_b")), "_told", "left")
    same = F.filter("_a", lambda x: x["s"] == F.col("_strict"))
    return joined.withColumn(name, F.coalesce(F.get(same, F.lit(0))["d"], F.get("_a", F.lit(0))["d"], F.get("_b", F.lit(0))["d"], "_own")).drop("_own", "_strict", "_told", "_a", "_b")


# The same told apart from the code above, for the SQL checks: a name is the list of its words and of its numbers' values.
NAMED_SQL = "CASE WHEN trim(coalesce(db_id, ''), e' \\t\\r\\n') = '' THEN split_part(id, ':', 2) ELSE db_id END"


def name_tokens_sql(name: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace(lower({name}), '[.]sqlite\\s*$', ''), '[a-z]+|[0-9]+'), lambda t: coalesce(try_cast(t AS BIGINT)::VARCHAR, t))"
