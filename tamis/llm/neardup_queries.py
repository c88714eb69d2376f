"""Queries of the near-duplicate problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.neardup import record_nodes, similar_nodes, similar_records
from tamis.llm.splits import spanning_forest
from tamis.session import materialize, table

FIELDS = ["question", "sql"]
THRESHOLD = 0.65


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_records(table(spark, sf_dir, "d_retry_corrected"), "rec_id", FIELDS, THRESHOLD).select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of similar records and the number of its links, copies included."""
    records = table(spark, sf_dir, "d_retry_corrected")
    members = materialize(record_nodes(records, "rec_id", FIELDS), "nodes")
    nodes = materialize(similar_nodes(records, members, "rec_id", FIELDS, THRESHOLD), "pairs")
    size = members.where("id != 0").groupBy("id").agg(F.count("*").alias("copies"), F.min("rec").alias("first"))
    ends = nodes.select("a", "b").unionByName(nodes.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(size.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    _, labels = spanning_forest(nodes.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).cast("bigint").alias("w")))
    of = size.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    name = of.groupBy("root").agg(F.min("first").alias("class_id"))
    told = of.join(name, "root").select("id", "class_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return members.join(told, "id", "left").select(F.col("rec").alias("rec_id"), F.coalesce("class_id", "rec").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
ORACLE: dict[str, str] = {
    "p3_found": """WITH w AS (SELECT rec_id, regexp_extract_all(strip_accents(lower(question)), '[a-z0-9]+') AS q, regexp_extract_all(strip_accents(lower(coalesce(sql, ''))), '[a-z0-9]+') AS s FROM d_retry_corrected),
g AS (SELECT rec_id, list_distinct(list_concat(list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1]), list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]))) AS g FROM w),
n AS (SELECT rec_id, len(g) AS n, g FROM g WHERE len(g) > 0),
t AS (SELECT rec_id, n, unnest(g) AS t FROM n),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t),
o AS (SELECT rec_id, n, t, row_number() OVER (PARTITION BY rec_id ORDER BY df, t) AS p FROM t JOIN f USING (t)),
x AS (SELECT rec_id, n, t FROM o WHERE p <= n - ceil(0.65 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.rec_id AS rec_a, b.rec_id AS rec_b FROM x a JOIN x b ON a.t = b.t AND a.rec_id < b.rec_id AND least(a.n, b.n) >= 0.65 * greatest(a.n, b.n) - 1e-9)
SELECT rec_a, rec_b FROM c JOIN n a ON a.rec_id = rec_a JOIN n b ON b.rec_id = rec_b
WHERE len(list_intersect(a.g, b.g)) >= 0.65 * (a.n + b.n - len(list_intersect(a.g, b.g))) - 1e-9""",
}

ORACLE["p3_classes"] = f"""WITH RECURSIVE p AS ({ORACLE["p3_found"]}), e AS (SELECT rec_a AS a, rec_b AS b FROM p UNION ALL SELECT rec_b, rec_a FROM p),
c(a, b) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e) UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), f AS (SELECT a, min(b) AS class_id FROM c GROUP BY a), l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT rec_id, coalesce(class_id, rec_id) AS class_id, coalesce(links, 0) AS links FROM d_retry_corrected LEFT JOIN f ON f.a = rec_id LEFT JOIN l ON l.a = rec_id"""
