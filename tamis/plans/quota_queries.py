"""Queries of quotas, sampling and positional windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tamis.operators import quotas as Q
from tamis.operators.metrics import ranked
from tamis.plans.relational_queries import run_sql
from tamis.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def shared(name: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLE[name] = sql


_LEVEL = "regexp_replace(lower(coalesce(hardness, '')), '[^a-z]', '', 'g')"
_level = lambda: F.regexp_replace(F.lower(F.coalesce("hardness", F.lit(""))), "[^a-z]", "").alias("level")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("q01_largest_remainder", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT source, n, 100 * n / sum(n) OVER () AS x FROM c),
r AS (SELECT *, floor(x) AS q, row_number() OVER (ORDER BY x - floor(x) DESC, source DESC) AS r FROM x)
SELECT source, n, (q + (r <= 100 - sum(q) OVER ())::INT)::BIGINT AS quota FROM r""")  # fmt: skip
def q01_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.largest_remainder(_by_source(spark, sf_dir), "source", "n", 100)


@query("q02_integer_remainder", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT source, n, n * 200 // (sum(n) OVER ())::BIGINT AS q, n * 200 % (sum(n) OVER ())::BIGINT AS m FROM c)
SELECT source, n, (q + (row_number() OVER (ORDER BY m DESC, source) <= 200 - sum(q) OVER ())::INT)::BIGINT AS quota FROM x""")  # fmt: skip
def q02_integer_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.integer_remainder(_by_source(spark, sf_dir), "source", "n", 200)


@query("q03_judge_selection", f"""WITH d AS (SELECT rec_id, {_LEVEL} AS level, len(coalesce(issues, [])) = 0 AS ok FROM d_retry_corrected),
p AS (SELECT rec_id, level, row_number() OVER (PARTITION BY level ORDER BY md5('42:' || rec_id), rec_id) AS n FROM d WHERE ok)
SELECT rec_id, level, 'deterministic_fail' AS selection FROM d WHERE NOT ok UNION ALL SELECT rec_id, level, 'random_pass' FROM p WHERE n <= 20""")  # fmt: skip
def q03_judge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures, and a reproducible draw of the rest in each level."""
    d = table(spark, sf_dir, "d_retry_corrected").select("rec_id", _level(), (F.size(F.coalesce("issues", F.array())) == 0).alias("ok"))
    quota = d.select("level").distinct().withColumn("quota", F.lit(20))
    drawn = Q.capped(d.where("ok"), ["level"], quota, Q.hash_order(42, "rec_id"), "rec_id")
    return d.where("NOT ok").select("rec_id", "level", F.lit("deterministic_fail").alias("selection")).unionByName(drawn.select("rec_id", "level", F.lit("random_pass").alias("selection")))


_NESTED_SQL = f"""WITH r AS (SELECT rec_id, {_LEVEL} AS level, coalesce(generation_mode, '') AS mode FROM d_retry_corrected),
s AS (SELECT level, mode, count(*) AS n, md5('7|' || level || '|' || mode) AS tie, 0::BIGINT AS q0 FROM r GROUP BY level, mode),
""" + ",\n".join(
    f"""b{i} AS (SELECT *, greatest(q{i - 1}, floor(n * {p} / 100)) AS b FROM s{'' if i == 1 else i - 1}),
s{i} AS (SELECT * EXCLUDE (b), least(n, b + (row_number() OVER (ORDER BY n * {p} / 100 - b DESC, tie DESC) <= floor(sum(n) OVER () * {p} / 100) - sum(b) OVER ())::INT)::BIGINT AS q{i} FROM b{i})"""
    for i, p in enumerate((25, 50, 75, 100), 1)
) + """, k AS (SELECT rec_id, level, mode, row_number() OVER (PARTITION BY level, mode ORDER BY md5('7:' || rec_id), rec_id) AS n FROM r)
SELECT k.rec_id, k.level, k.mode, CASE WHEN k.n <= q1 THEN 25 WHEN k.n <= q2 THEN 50 WHEN k.n <= q3 THEN 75 WHEN k.n <= q4 THEN 100 END AS first_percent FROM k JOIN s4 USING (level, mode)"""


@query("q04_nested_subsets", _NESTED_SQL)
def q04_nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "d_retry_corrected").select("rec_id", _level(), F.coalesce("generation_mode", F.lit("")).alias("mode"))
    return Q.nested_subsets(d, ["level", "mode"], "rec_id", [25, 50, 75, 100], 7)


ORACLE["win14_nested_subset_sizes"] = f"SELECT first_percent, count(*) AS n FROM ({_NESTED_SQL}) GROUP BY first_percent"
QUERIES["win14_nested_subset_sizes"] = lambda spark, sf_dir: q04_nested_subsets(spark, sf_dir).groupBy("first_percent").agg(F.count("*").alias("n"))


@query("q05_water_filling")
def q05_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed records of each database up to a weighted share, deficits shared out; the plan has a row a database."""
    d = table(spark, sf_dir, "d_retry_corrected").where("lower(verdict) = 'pass'").select("rec_id", "db_id")
    supply = {r["db_id"]: r["n"] for r in d.where("db_id IS NOT NULL").groupBy("db_id").agg(F.count("*").alias("n")).collect()}
    weights = {r["db_id"]: float(r["source_examples"] or 0) for r in table(spark, sf_dir, "seed_plan").select("db_id", "source_examples").collect()}
    taken = Q.water_filling(supply, weights, sum(supply.values()) // 2)
    quota = spark.createDataFrame(sorted(taken.items()), "db_id string, quota bigint")
    return Q.capped(d, ["db_id"], quota, Q.hash_order(42, "rec_id"), "rec_id").select("rec_id", "db_id")


@query("q06_sha_pick", "SELECT item_id FROM heldout_items ORDER BY sha256('42:' || question), item_id LIMIT 4")
def q06_sha_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "heldout_items").orderBy(F.sha2(F.concat(F.lit("42:"), "question"), 256), "item_id").limit(4).select("item_id")


@query("q07_seeded_sample", "SELECT rec_id FROM d_retry_corrected ORDER BY md5('42:' || rec_id), rec_id LIMIT 150")
def q07_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "d_retry_corrected").select("rec_id").orderBy(Q.hash_order(42, "rec_id"), "rec_id").limit(150)


_QUOTA = """WITH x AS (SELECT db_id, target_quota AS w, 300 * target_quota / sum(target_quota) OVER () AS x FROM seed_plan WHERE target_quota IS NOT NULL),
r AS (SELECT *, floor(x) AS q, row_number() OVER (ORDER BY x - floor(x) DESC, db_id DESC) AS r FROM x), q AS (SELECT db_id, (q + (r <= 300 - sum(q) OVER ())::INT)::BIGINT AS quota FROM r)
"""


@query("q08_prompts_per_base", _QUOTA + "SELECT db_id, greatest(1, quota) AS prompts FROM q")
def q08_prompts_per_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "seed_plan").where("target_quota IS NOT NULL").select("db_id", "target_quota")
    return Q.largest_remainder(plan, "db_id", "target_quota", 300).select("db_id", F.greatest(F.lit(1), "quota").alias("prompts"))


@query("q09_complement_plan", """WITH h AS (SELECT db_id, count(*) AS n FROM d_retry_corrected WHERE lower(verdict) = 'pass' GROUP BY db_id)
SELECT db_id, greatest(target_quota - coalesce(n, 0), 0)::BIGINT AS missing, ceil(greatest(target_quota - coalesce(n, 0), 0) * 1.3)::BIGINT AS request FROM seed_plan LEFT JOIN h USING (db_id)""")  # fmt: skip
def q09_complement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "seed_plan").select("db_id", F.col("target_quota").cast("bigint").alias("quota"))
    return Q.complement(targets, table(spark, sf_dir, "d_retry_corrected").where("lower(verdict) = 'pass'"), ["db_id"], 1.3)


@query("q10_hardness_quotas", """WITH e AS (SELECT db_id, coalesce(target_quota, 0) AS t, unnest(map_keys(hardness_counts)) AS level, unnest(map_values(hardness_counts)) AS w FROM seed_plan),
x AS (SELECT *, t * w / sum(w) OVER (PARTITION BY db_id) AS x FROM e WHERE w > 0), r AS (SELECT *, floor(x) AS q, row_number() OVER (PARTITION BY db_id ORDER BY x - floor(x) DESC, level DESC) AS r FROM x)
SELECT db_id, level, (q + (r <= t - sum(q) OVER (PARTITION BY db_id))::INT)::BIGINT AS quota FROM r""")  # fmt: skip
def q10_hardness_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each database's target split over its levels in proportion."""
    e = table(spark, sf_dir, "seed_plan").select("db_id", F.coalesce("target_quota", F.lit(0)).alias("t"), F.explode("hardness_counts").alias("level", "w")).where("w > 0")
    return Q.largest_remainder(e, "level", "w", F.col("t"), by=["db_id"]).select("db_id", "level", "quota")


@query("q11_seed_plan", """WITH c AS (SELECT db_id, count(*) AS w FROM d_retry_corrected WHERE db_id IN (SELECT db_id FROM db_catalogue) GROUP BY db_id),
a AS (SELECT db_id, w, 500 * w / sum(w) OVER () AS x FROM c), b AS (SELECT *, floor(x) AS q, row_number() OVER (ORDER BY x - floor(x) DESC, db_id DESC) AS r FROM a)
SELECT db_id, w AS source_examples, (q + (r <= 500 - sum(q) OVER ())::INT)::BIGINT AS target_quota, ceil((q + (r <= 500 - sum(q) OVER ())::INT) * 1.25)::BIGINT AS request_quota FROM b""")  # fmt: skip
def q11_seed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "db_catalogue").select("db_id")
    c = table(spark, sf_dir, "d_retry_corrected").join(known, "db_id", "left_semi").groupBy("db_id").agg(F.count("*").alias("source_examples"))
    return Q.largest_remainder(c, "db_id", "source_examples", 500, name="target_quota").withColumn("request_quota", F.ceil(F.col("target_quota") * 1.25))


@query("q12_equal_groups", f"""WITH d AS (SELECT rec_id, {_LEVEL} AS level FROM d_retry_corrected WHERE hardness IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('5:' || rec_id), rec_id) AS n, count(*) OVER (PARTITION BY level) AS c FROM d)
SELECT rec_id, level FROM r WHERE n <= (SELECT min(c) FROM r)""")  # fmt: skip
def q12_equal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of each level as the smallest has."""
    d = table(spark, sf_dir, "d_retry_corrected").where("hardness IS NOT NULL").select("rec_id", _level())
    counts = d.groupBy("level").agg(F.count("*").alias("c"))
    quota = counts.select("level", F.min("c").over(Window.partitionBy(F.lit(1))).alias("quota"))
    return Q.capped(d, ["level"], quota, Q.hash_order(5, "rec_id"), "rec_id")


@query("win04_quota_capped", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 50")
def win04_quota_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    quota = o.select("o_orderpriority", "o_orderstatus").distinct().withColumn("quota", F.lit(50))
    return Q.capped(o, ["o_orderpriority", "o_orderstatus"], quota, "o_orderkey").select("o_orderkey")


@query("win05_rotating_remainder", """WITH t AS (SELECT db_id, target_quota AS t, coalesce(sum(target_quota % 4) OVER (ORDER BY db_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM seed_plan WHERE target_quota IS NOT NULL),
l AS (SELECT db_id, t, c, unnest(['easy', 'medium', 'hard', 'extra']) AS level, unnest([0, 1, 2, 3]) AS i FROM t)
SELECT db_id, level, (t // 4 + ((((i - c) % 4 + 4) % 4) < t % 4)::INT)::BIGINT AS quota FROM l""")  # fmt: skip
def win05_rotating_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rotating_levels(table(spark, sf_dir, "seed_plan").where("target_quota IS NOT NULL").select("db_id", "target_quota"), "db_id", "target_quota", ["easy", "medium", "hard", "extra"])


@query("win06_odd_halves", """WITH t AS (SELECT db_id, target_quota AS t, target_quota % 2 AS o, row_number() OVER (PARTITION BY target_quota % 2 ORDER BY db_id) AS r, sum(target_quota % 2) OVER () AS n FROM seed_plan WHERE target_quota IS NOT NULL),
f AS (SELECT db_id, t, t // 2 + (o = 1 AND r <= (n + 1) // 2)::INT AS f FROM t)
SELECT db_id, 'hard' AS level, f::BIGINT AS quota FROM f UNION ALL SELECT db_id, 'extra', (t - f)::BIGINT FROM f""")  # fmt: skip
def win06_odd_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.halves(table(spark, sf_dir, "seed_plan").where("target_quota IS NOT NULL").select("db_id", "target_quota"), "db_id", "target_quota", ("hard", "extra"))


@query("win07_distinct_top_k", """WITH e AS (SELECT custom_id, built_at, unnest(exemplars) AS e FROM request_meta), d AS (SELECT custom_id, built_at, e.structure AS structure, min(e.sql) AS sql FROM e WHERE e.structure IS NOT NULL AND e.sql IS NOT NULL GROUP BY ALL)
SELECT custom_id, built_at, structure, sql FROM (SELECT *, row_number() OVER (PARTITION BY custom_id, built_at ORDER BY md5('3:' || structure), structure) AS n FROM d) WHERE n <= 3""")  # fmt: skip
def win07_distinct_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three exemplars of different structure for each request."""
    e = table(spark, sf_dir, "request_meta").select("custom_id", "built_at", F.explode("exemplars").alias("e")).where("e.structure IS NOT NULL AND e.sql IS NOT NULL")
    d = e.groupBy("custom_id", "built_at", F.col("e.structure").alias("structure")).agg(F.min("e.sql").alias("sql"))
    n = F.row_number().over(Window.partitionBy("custom_id", "built_at").orderBy(Q.hash_order(3, "structure"), "structure"))
    return d.withColumn("n", n).where("n <= 3").drop("n")


@query("win08_position_chunks", "SELECT rec_id, ((row_number() OVER (ORDER BY rec_id) - 1) // 50)::BIGINT AS chunk FROM d_retry_corrected")
def win08_position_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by position over the whole table, numbered without one task for all rows."""
    return ranked(table(spark, sf_dir, "d_retry_corrected").select("rec_id"), [F.col("rec_id")]).select("rec_id", F.floor((F.col("position") - 1) / 50).alias("chunk"))


@query("win09_mixed_chunks")
def win09_mixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request chunks that keep each database's mix of levels: iterative, tested by its invariants."""
    import pandas as pd

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        quotas = dict(zip(pdf["level"], pdf["quota"].astype(int), strict=True))
        rows = [(pdf["db_id"].iloc[0], i, level, n) for i, chunk in enumerate(Q.mixed_chunks(quotas, 8)) for level, n in sorted(chunk.items())]
        return pd.DataFrame(rows, columns=["db_id", "chunk", "level", "n"])

    return q10_hardness_quotas(spark, sf_dir).where("quota > 0").groupBy("db_id").applyInPandas(plan, "db_id string, chunk int, level string, n int")


shared("win12_first_and_last", "SELECT user_id, min_by(event_type, ts) AS first_type, max_by(event_type, ts) AS last_type, count(*) AS n FROM events GROUP BY user_id")


@query("srt02_sorted", "SELECT db_id, target_quota, row_number() OVER (ORDER BY db_id) AS place FROM seed_plan")
def srt02_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "seed_plan").select("db_id", "target_quota"), [F.col("db_id")]).withColumnRenamed("position", "place")


@query("srt03_length_order", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def srt03_length_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the longest first."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [-F.col("n_chars"), F.col("doc_id")]).withColumnRenamed("position", "place")


shared("srt04_prefix", "SELECT rec_id, id FROM d_retry_corrected ORDER BY rec_id LIMIT 10")
shared("srt06_bounded_fetch", "SELECT count(*) AS n FROM (SELECT 1 AS x FROM lineitem WHERE l_quantity > 10 LIMIT 1000) t")
