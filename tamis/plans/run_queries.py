"""Queries that execute statements and compare their results, and queries over streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.sqltext import QUERY_TYPES, clean_sql, query_types
from tamis.functions.words import word_text
from tamis.operators import metrics as M
from tamis.operators.execute import check_statements, execute_built, score
from tamis.operators.stats import cluster_bootstrap, mcnemar, paired
from tamis.session import materialize, table
from tamis.streaming import telemetry

# Statements over a database a region with its nations, for each of its databases and each nation's key k: a number, the
# level, the gold statement, and what two runs put out. Both the queries and their SQL below know them by number.
TEMPLATES = [
    ("easy", "SELECT count(*) FROM nation WHERE n_nationkey > {k}", "```sql\nSELECT count(*) FROM nation WHERE n_nationkey > {k};\n```", "SELECT count(*) FROM nation WHERE n_nationkey >= {k}"),
    ("easy", "SELECT n_name FROM nation WHERE n_nationkey > {k}", "SELECT n_name FROM nation WHERE n_nationkey > {k} ORDER BY n_nationkey DESC", "select  n_name from nation WHERE n_nationkey > {k}"),
    ("medium", "SELECT n_name FROM nation WHERE n_nationkey > {k} ORDER BY n_name", "SELECT n_name FROM nation WHERE n_nationkey > {k} ORDER BY n_name DESC", "SQL: SELECT n_name FROM nation WHERE n_nationkey > {k} ORDER BY n_nationkey"),
    ("medium", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > {k}", "SELECT n_name, n_nationkey FROM nation WHERE n_nationkey > {k}", "SELECT n_name FROM nation WHERE n_nationkey > {k}"),
    ("hard", "SELECT n_regionkey, count(*) FROM nation WHERE n_nationkey > {k} GROUP BY n_regionkey", "SQLQuery: SELECT n_regionkey, count(*) FROM nation WHERE n_nationkey > {k} GROUP BY n_regionkey", "SELECT count(*) * 1.0, n_regionkey FROM nation WHERE n_nationkey > {k} GROUP BY n_regionkey"),
    ("hard", "SELECT max(n_nationkey) FROM nation WHERE n_nationkey > {k}", "SELECT max(n_clef) FROM nation WHERE n_nationkey > {k}", "<think>the largest</think>SELECT max(n_nationkey) * 1.0 FROM nation WHERE n_nationkey > {k}"),
    ("extra", "SELECT r_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey > {k} GROUP BY r_name", "DELETE FROM region", "SELECT r_name FROM region"),
    ("extra", "SELECT count(*) FROM (SELECT n_name FROM nation WHERE n_nationkey > {k})", "", "SELECT count(* FROM nation"),
]
SLOW = "WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r) SELECT count(*) FROM r"


def _databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(db_id, script): one small database a region; nations and regions don't grow with the data."""
    text = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    nation = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(", "), text("n_name"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(")"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(nation)), ", ").alias("rows"))
    ddl = "CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT); CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER REFERENCES region(r_regionkey));"
    inserts = F.concat(F.lit(" INSERT INTO region VALUES ("), F.col("r_regionkey").cast("string"), F.lit(", "), text("r_name"), F.lit("); INSERT INTO nation VALUES "), "rows", F.lit(";"))
    return table(spark, sf_dir, "region").join(rows, "r_regionkey").select(F.col("r_name").alias("db_id"), F.concat(F.lit(ddl), inserts).alias("script"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, db_id, level, gold, a, b) of every template, database and key."""
    shapes = spark.createDataFrame([(i, *x) for i, x in enumerate(TEMPLATES)], "t int, level string, gold string, a string, b string")
    keys = table(spark, sf_dir, "nation").select("n_nationkey")
    every = table(spark, sf_dir, "region").select(F.col("r_name").alias("db_id")).join(keys).join(F.broadcast(shapes))
    filled = [F.replace(F.col(c), F.lit("{k}"), F.col("n_nationkey").cast("string")).alias(c) for c in ("gold", "a", "b")]
    made = every.select(F.concat_ws(":", F.lit("n"), "db_id", F.col("t").cast("string"), F.col("n_nationkey").cast("string")).alias("id"), "db_id", "level", *filled)
    return made.unionByName(spark.createDataFrame([("n:slow", "AFRICA", "extra", "SELECT 1", SLOW, "SELECT 1.0")], made.schema))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an example and run: cleaned, executed on SQLite inside the executors, compared under three equalities."""
    examples = _examples(spark, sf_dir)
    each = examples.select("id", "db_id", "level", F.col("gold"), F.explode(F.array(*(F.struct(F.lit(r).alias("run"), F.col(r).alias("output")) for r in "ab"))).alias("o")).select("id", "db_id", "level", "gold", "o.*")
    cleaned = materialize(each.withColumn("sql", clean_sql(F.col("output"))), "outputs")
    results = materialize(execute_built(cleaned.select("db_id", "sql").union(cleaned.select("db_id", "gold")), _databases(spark, sf_dir), timeout=1.0), "results")
    gold = examples.select("id", F.col("gold").alias("sql"))
    scored = cleaned.select(F.concat_ws("|", "id", "run").alias("id"), "db_id", "sql")
    golds = gold.select(F.explode(F.array(*(F.concat_ws("|", "id", F.lit(r)) for r in "ab"))).alias("id"), "sql")
    told = score(scored, golds, results)
    key = F.split("id", r"\|")
    rest = cleaned.select("id", "run", "level", "gold", (F.coalesce("sql", F.lit("")) == "").alias("empty"))
    return materialize(told.withColumns({"run": key[1], "id": key[0]}).join(rest, ["id", "run"]), "scored")


def x01_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each gold statement gives: rows and the cells of the first one."""
    examples = _examples(spark, sf_dir).where("id != 'n:slow'")
    results = execute_built(examples.select("db_id", F.col("gold").alias("sql")), _databases(spark, sf_dir))
    told = results.select("db_id", F.col("sql").alias("gold"), "ok", F.size("rows").alias("n_rows"), F.coalesce(F.array_join(F.array_sort(F.flatten("rows")), " "), F.lit("")).alias("cells"))
    return examples.join(told, ["db_id", "gold"]).select("id", "ok", "n_rows", "cells")


def x08_scored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "run", "exact_match", "executed", "syntax_valid", "strict", "bag", "permuted")



def x12_score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's accuracy under three equalities and its errors."""
    flags = {"exact": "exact_match", "strict": "strict", "bag": "bag", "permuted": "permuted", "executed": "executed", "empty": "empty"}
    counts = [F.count_if(c).alias(n) for n, c in flags.items()]
    errors = [F.count_if(~F.col("syntax_valid")).alias("syntax_errors"), F.count_if(F.coalesce(F.lower("error").contains("no such column"), F.lit(False))).alias("missing_columns"), F.count_if(F.coalesce(F.col("error").startswith("timeout"), F.lit(False))).alias("timeouts")]
    return _scored(spark, sf_dir).groupBy("run").agg(F.count("*").alias("examples"), *counts, *errors)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.where("run = 'a'").select("id", "db_id", "level", "gold", F.col("permuted").alias("base"), F.col("strict").alias("base_strict")).join(s.where("run = 'b'").select("id", F.col("permuted").alias("candidate"), F.col("strict").alias("candidate_strict")), "id")


def _changes() -> dict:
    return {"base": F.col("base"), "candidate": F.col("candidate"), "gained": F.col("candidate") & ~F.col("base"), "lost": F.col("base") & ~F.col("candidate")}


def x13_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run b against run a: pairs gained and lost with McNemar's p, overall and by level."""
    levels = M.by_group_with_total(_paired(spark, sf_dir), "level", _changes())
    return levels.withColumn("p", F.round(mcnemar(F.col("gained"), F.col("lost")), 6))


def x13_query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by overlapping types of the gold statement."""
    both = _paired(spark, sf_dir)
    types = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in query_types(F.col("gold")).items())))
    each = both.withColumn("query_type", F.explode(types))
    return each.groupBy("query_type").agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in _changes().items()))


def x13_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean gain of run b with its interval over databases drawn again."""
    return cluster_bootstrap(_paired(spark, sf_dir), "db_id", F.col("candidate").cast("int") - F.col("base").cast("int"), 200, 42)


def x20_paired_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(_paired(spark, sf_dir), F.col("base_strict"), F.col("candidate_strict"))


def x09_record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that ask the same question of the same schema, scored against the first of them on an empty database.

    Statements that fail tell what is missing; on an empty database equality tells whether the results have one form.
    """
    d = table(spark, sf_dir, "d_retry_corrected").select("rec_id", F.sha2("schema", 256).alias("db_id"), word_text(F.col("question")).alias("asked"), clean_sql(F.col("sql")).alias("sql")).where("asked != '' AND db_id IS NOT NULL")
    first = d.groupBy("db_id", "asked").agg(F.min_by("sql", "rec_id").alias("gold"), F.min("rec_id").alias("first"))
    pairs = materialize(d.join(first, ["db_id", "asked"]).where("rec_id != first").select(F.col("rec_id").alias("id"), "db_id", "sql", "gold"), "pairs")
    schemas = table(spark, sf_dir, "d_retry_corrected").select(F.sha2("schema", 256).alias("db_id"), F.col("schema").alias("script")).where("script IS NOT NULL").dropDuplicates(["db_id"])
    results = materialize(execute_built(pairs.select("db_id", "sql").union(pairs.select("db_id", "gold")), schemas, most_rows=1000), "results")
    told = score(pairs.select("id", "db_id", "sql"), pairs.select("id", F.col("gold").alias("sql")), results)
    return told.select(F.col("id").alias("rec_id"), "gold_ok", "exact_match", "executed", "syntax_valid", "strict", "bag", "permuted")


def x02_light_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each record's cleaned statement runs on an empty database of its schema, and its hardness."""
    d = table(spark, sf_dir, "d_retry_corrected").select("rec_id", clean_sql(F.col("sql")).alias("statement"), "schema")
    return check_statements(d, "rec_id", "statement", "schema")


def st1_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly events of each type, as a stream of files run to its end."""
    events = telemetry.read_parquet_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = telemetry.run_once(telemetry.window_counts(events, "ts", "event_type"), "complete")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def st1_stateful_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas between the events of each user, with the last one kept as state."""
    events = telemetry.read_parquet_stream(spark, f"{sf_dir}/events.parquet")
    logs = events.select(F.col("user_id").alias("part"), F.col("event_id").alias("step"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return telemetry.run_once(telemetry.log_deltas(logs), "append").withColumn("d_seconds", F.round("d_seconds", 3))


QUERIES = {
    "x01_executed": x01_executed, "x02_light_check": x02_light_check, "x08_scored_examples": x08_scored_examples, "x09_record_scores": x09_record_scores, "x12_score_report": x12_score_report,
    "x13_run_comparison": x13_run_comparison, "x13_query_types": x13_query_types, "x13_bootstrap": x13_bootstrap, "x20_paired_total": x20_paired_total,
    "st1_window_counts": st1_window_counts, "st1_stateful_deltas": st1_stateful_deltas,
}

# What the statements of TEMPLATES must give, worked out from the tables: n nations of the region lie beyond the key.
_EXPECTED = """WITH k AS (SELECT r_name AS db, r_regionkey AS rk, x.n_nationkey AS k FROM region, nation x),
c AS (SELECT db, k, rk, count(n.n_nationkey) AS n, coalesce(bool_or(n.n_nationkey = k), false) AS has, max(n.n_nationkey) FILTER (n.n_nationkey > k) AS top,
  count(*) FILTER (n.n_nationkey > k) AS m, list(n.n_name ORDER BY n.n_nationkey) FILTER (n.n_nationkey > k) AS by_key, list(n.n_name ORDER BY n.n_name) FILTER (n.n_nationkey > k) AS by_name
  FROM k LEFT JOIN nation n ON n.n_regionkey = rk GROUP BY ALL),
s AS (SELECT *, m <= 1 AS few, m = 0 AS none, coalesce(by_key = by_name, true) AS sorted FROM c),
e(db, k, t, level, run, exact, executed, valid, strict, bag, permuted, missing, empty, m) AS (
SELECT db, k, 0, 'easy', 'a', true, true, true, true, true, true, false, false, m FROM s UNION ALL SELECT db, k, 0, 'easy', 'b', false, true, true, NOT has, NOT has, NOT has, false, false, m FROM s
UNION ALL SELECT db, k, 1, 'easy', 'a', false, true, true, few, true, true, false, false, m FROM s UNION ALL SELECT db, k, 1, 'easy', 'b', true, true, true, true, true, true, false, false, m FROM s
UNION ALL SELECT db, k, 2, 'medium', 'a', false, true, true, few, few, few, false, false, m FROM s UNION ALL SELECT db, k, 2, 'medium', 'b', false, true, true, sorted, sorted, sorted, false, false, m FROM s
UNION ALL SELECT db, k, 3, 'medium', 'a', false, true, true, none, none, true, false, false, m FROM s UNION ALL SELECT db, k, 3, 'medium', 'b', false, true, true, none, none, none, false, false, m FROM s
UNION ALL SELECT db, k, 4, 'hard', 'a', true, true, true, true, true, true, false, false, m FROM s UNION ALL SELECT db, k, 4, 'hard', 'b', false, true, true, none OR rk = m, none OR rk = m, none OR rk = m, false, false, m FROM s
UNION ALL SELECT db, k, 5, 'hard', 'a', false, false, true, false, false, false, true, false, m FROM s UNION ALL SELECT db, k, 5, 'hard', 'b', false, true, true, true, true, true, false, false, m FROM s
UNION ALL SELECT db, k, 6, 'extra', 'a', false, false, true, false, false, false, false, false, m FROM s UNION ALL SELECT db, k, 6, 'extra', 'b', false, true, true, NOT none, NOT none, NOT none, false, false, m FROM s
UNION ALL SELECT db, k, 7, 'extra', 'a', false, false, true, false, false, false, false, true, m FROM s UNION ALL SELECT db, k, 7, 'extra', 'b', false, false, false, false, false, false, false, false, m FROM s),
f AS (SELECT 'n:' || db || ':' || t || ':' || k AS id, * EXCLUDE (k, m) FROM e
UNION ALL SELECT 'n:slow', 'AFRICA', -1, 'extra', 'a', false, false, true, false, false, false, false, false UNION ALL SELECT 'n:slow', 'AFRICA', -1, 'extra', 'b', false, true, true, true, true, true, false, false),
p AS (SELECT id, a.db, a.t, a.level, a.permuted AS base, b.permuted AS candidate, a.strict AS base_strict, b.strict AS candidate_strict FROM f a JOIN f b USING (id) WHERE a.run = 'a' AND b.run = 'b')
"""
_DELTA = "count(*) AS n, count_if(base)::BIGINT AS base, count_if(candidate)::BIGINT AS candidate, count_if(candidate AND NOT base)::BIGINT AS gained, count_if(base AND NOT candidate)::BIGINT AS lost"
# The two-sided binomial tail of McNemar's test, summed term by term.
_TAIL = "CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda j: exp(lgamma(gained + lost + 1) - lgamma(j + 1) - lgamma(gained + lost - j + 1) - (gained + lost) * ln(2))))) END"
_KIND = ", ".join(f"('{n}', list_contains([{', '.join(str(i) for i, x in enumerate(TEMPLATES) if re.search(p, x[1].lower()))}]::INT[], t))" for n, p in QUERY_TYPES.items())

ORACLE = {
    "x01_executed": _EXPECTED + """, r AS (SELECT e.db, e.k, e.t, s.* EXCLUDE (db, k) FROM e JOIN s USING (db, k) WHERE run = 'a')
SELECT 'n:' || db || ':' || t || ':' || k AS id, true AS ok, (CASE WHEN t IN (0, 5, 7) THEN 1 WHEN t IN (4, 6) THEN (m > 0)::INT ELSE m END)::INT AS n_rows,
  CASE WHEN t IN (0, 7) THEN 'i:' || m WHEN t = 5 THEN coalesce('i:' || top, 'n') WHEN m = 0 THEN '' WHEN t = 4 THEN list_aggregate(list_sort(['i:' || rk, 'i:' || m]), 'string_agg', ' ') WHEN t = 6 THEN 't:' || db
  WHEN t = 3 THEN list_aggregate(list_sort(list_concat(list_transform(by_key, lambda x: 't:' || x), (SELECT list('i:' || n_nationkey) FROM nation n WHERE n.n_regionkey = r.rk AND n.n_nationkey > r.k))), 'string_agg', ' ')
  ELSE list_aggregate(list_sort(list_transform(by_key, lambda x: 't:' || x)), 'string_agg', ' ') END AS cells FROM r""",
    "x08_scored_examples": _EXPECTED + "SELECT id, run, exact AS exact_match, executed, valid AS syntax_valid, strict, bag, permuted FROM f",
    "x12_score_report": _EXPECTED + """SELECT run, count(*) AS examples, count_if(exact) AS exact, count_if(strict) AS strict, count_if(bag) AS bag, count_if(permuted) AS permuted, count_if(executed) AS executed, count_if(empty) AS empty,
  count_if(NOT valid) AS syntax_errors, count_if(missing) AS missing_columns, count_if(id = 'n:slow' AND run = 'a') AS timeouts FROM f GROUP BY run""",
    "x13_run_comparison": _EXPECTED + f"SELECT level, n, base, candidate, gained, lost, round({_TAIL}, 6) AS p FROM (SELECT coalesce(level, 'total') AS level, {_DELTA} FROM p GROUP BY ROLLUP (level))",
    "x13_query_types": _EXPECTED + f""", q AS (SELECT p.*, x.n AS query_type FROM p, LATERAL (SELECT * FROM (VALUES {_KIND}, ('one_table', t <> 6)) v(n, ok)) x WHERE x.ok)
SELECT query_type, {_DELTA} FROM q GROUP BY query_type""",
    "x13_bootstrap": _EXPECTED + """, w AS (SELECT db AS c, sum(candidate::INT - base::INT) AS s, count(*) AS n, row_number() OVER (ORDER BY db) - 1 AS i FROM p GROUP BY db), kk AS (SELECT count(*) AS k FROM w),
z AS (SELECT rep, slot, k FROM kk, unnest(range(0, 200)) r(rep), unnest(range(0, k)) t(slot)), y AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || slot), 1, 8))::BIGINT % k AS i FROM z),
b AS (SELECT rep, sum(s) / sum(n) AS mean FROM y JOIN w USING (i) GROUP BY rep), v AS (SELECT list_sort(list(mean)) AS v FROM b)
SELECT (SELECT sum(s) / sum(n) FROM w) AS mean, v[6] AS low, v[195] AS high FROM v""",
    "x20_paired_total": _EXPECTED + "SELECT count(*) AS n, count_if(candidate_strict AND NOT base_strict) AS gained, count_if(base_strict AND NOT candidate_strict) AS lost, 100.0 * (count_if(candidate_strict) - count_if(base_strict)) / count(*) AS delta_points FROM p",
    "st1_stateful_deltas": """WITH d AS (SELECT user_id AS part, event_id AS step, event_id - lag(event_id) OVER w AS d_step, epoch(ts) - lag(epoch(ts)) OVER w AS d_seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT part, step, d_step, round(d_seconds, 3) AS d_seconds FROM d WHERE d_seconds > 0""",
    "st1_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
