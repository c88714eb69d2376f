"""Queries of the split problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.words import word_text
from tamis.llm.records import NAMED_SQL, name_tokens_sql, params, with_database
from tamis.llm.splits import grouped_records, question_links, spanning_forest, split_records
from tamis.session import materialize, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_database(table(spark, sf_dir, "d_retry_corrected").select("rec_id", "id", "db_id", "question"), table(spark, sf_dir, "db_catalogue"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_records(_records(spark, sf_dir), "db", "question").select("rec_id", "group_db")


def _shares(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    p = params(spark, sf_dir)
    return [(s, p[f"p2_{s}_share"]) for s in ("train", "validation", "test")]


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(_records(spark, sf_dir), "db", "question", _shares(spark, sf_dir)).select("rec_id", "group_db", "split")


def p2_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares met beside those asked for."""
    wanted = spark.createDataFrame(_shares(spark, sf_dir), "split string, target_share double")
    counts = p2_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("group_db").alias("groups"))
    total = counts.agg(F.sum("records").alias("total"))
    return wanted.join(counts, "split", "left").join(F.broadcast(total)).select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.coalesce("records", F.lit(0)) / F.col("total")).alias("share"))


def p2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest's edges with the number of questions the two databases share."""
    forest, _ = spanning_forest(question_links(_records(spark, sf_dir), "db", "question"))
    return forest if forest is not None else spark.createDataFrame([], "u string, v string, w bigint")


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: records, groups that lie in several splits, questions that do, and splits further than a point from their share."""
    d = materialize(split_records(_records(spark, sf_dir), "db", "question", _shares(spark, sf_dir)).select("group_db", "db", word_text(F.col("question")).alias("q"), "split"), "split")
    apart = lambda c: d.groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*"))
    wanted = spark.createDataFrame(_shares(spark, sf_dir), "split string, target double")
    total = d.agg(F.count("*").alias("total"))
    far = wanted.join(d.groupBy("split").agg(F.count("*").alias("n")), "split", "left").crossJoin(F.broadcast(total))
    far = far.where(F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("target")) > 0.01).agg(F.count("*"))
    one = lambda df, name: df.toDF(name)
    questions = d.where("q != ''").groupBy("q").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*"))
    parts = [one(apart("group_db"), "split_groups"), one(apart("db"), "split_databases"), one(questions, "split_questions"), one(far, "far_shares")]
    out = total.withColumnRenamed("total", "records")
    for p in parts:
        out = out.crossJoin(F.broadcast(p))  # of one row each
    return out


QUERIES = {"p2_invariants": p2_invariants, "p2_found": p2_found, "p2_splits": p2_splits, "p2_split_report": p2_split_report, "p2_forest": p2_forest}

ORACLE = {
    "p2_found": f"""WITH RECURSIVE c AS (SELECT {name_tokens_sql('db_id')} AS k, min(db_id) AS db FROM db_catalogue GROUP BY 1),
r AS (SELECT rec_id, array_to_string(regexp_extract_all(strip_accents(lower(question)), '[a-z0-9]+'), ' ') AS q, {name_tokens_sql(NAMED_SQL)} AS k FROM d_retry_corrected),
n AS (SELECT rec_id, q, coalesce(db, array_to_string(k, '')) AS db FROM r LEFT JOIN c USING (k)),
p AS (SELECT DISTINCT q, db FROM n WHERE q <> ''),
e AS (SELECT DISTINCT x.db AS a, y.db AS b FROM p x JOIN p y ON x.q = y.q WHERE x.db <> y.db),
t(a, b) AS (SELECT DISTINCT db, db FROM n UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
g AS (SELECT a, min(b) AS g FROM t GROUP BY a)
SELECT rec_id, g AS group_db FROM n JOIN g ON n.db = g.a""",
    "p2_invariants": "SELECT count(*) AS records, 0::BIGINT AS split_groups, 0::BIGINT AS split_databases, 0::BIGINT AS split_questions, 0::BIGINT AS far_shares FROM d_retry_corrected",
}
