"""Queries of the record layer: sources' envelopes, projections, validation, joins, dedup and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.sqltext import question_key
from tamis.operators import records as R
from tamis.operators.metrics import ranked
from tamis.plans.relational_queries import run_sql
from tamis.plans.text_queries import numbers_sql
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
    """A query whose SQL both engines run."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLE[name] = sql


_recs = lambda spark, sf_dir: table(spark, sf_dir, "d_retry_corrected")


@query("src11_chat_text", """WITH j AS (SELECT line_id, raw::JSON AS r FROM batch_responses WHERE json_valid(raw)),
m AS (SELECT line_id, r->'$.response.body.choices[0].message.content' AS c FROM j WHERE json_type(r->'$.response.body') = 'OBJECT')
SELECT line_id, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(c::JSON[], lambda b: b->>'$.type' = 'text'), lambda b: b->>'$.text'), '') END AS text FROM m WHERE c IS NOT NULL""")  # fmt: skip
def src11_chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the first choice: a string, or the text blocks joined."""
    v = F.try_parse_json("raw")
    content = F.try_variant_get(v, "$.response.body.choices[0].message.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string"))
    d = table(spark, sf_dir, "batch_responses").select("line_id", content.alias("c"), F.when(blocks.isNotNull(), F.array_join(texts, "")).otherwise(F.try_variant_get(content, "$", "string")).alias("text"))
    return d.where("c IS NOT NULL").drop("c")


@query("src12_first_output_text", """WITH j AS (SELECT line_id, raw::JSON->'$.response.body.output' AS o FROM batch_responses WHERE json_valid(raw)),
b AS (SELECT line_id, list_filter(flatten(list_transform(o::JSON[], lambda i: CASE WHEN json_type(i->'$.content') = 'ARRAY' THEN (i->'$.content')::JSON[] ELSE []::JSON[] END)), lambda b: b->>'$.type' = 'output_text') AS b FROM j WHERE json_type(o) = 'ARRAY')
SELECT line_id, b[1]->>'$.text' AS text FROM b WHERE b[1]->>'$.text' IS NOT NULL""")  # fmt: skip
def src12_first_output_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first output_text block of a response."""
    output = F.try_variant_get(F.try_parse_json("raw"), "$.response.body.output", "array<variant>")
    blocks = F.flatten(F.transform(output, lambda i: F.coalesce(F.try_variant_get(i, "$.content", "array<variant>"), F.array())))
    texts = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "output_text")
    return table(spark, sf_dir, "batch_responses").select("line_id", F.try_variant_get(F.get(texts, F.lit(0)), "$.text", "string").alias("text")).where("text IS NOT NULL")



@query("src06_sample_rows", "SELECT 'supplier' AS table_name, s_suppkey, concat_ws(' | ', s_suppkey::VARCHAR, substr(s_name, 1, 40), s_nationkey::VARCHAR) AS shown FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 3)")
def src06_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table as short text."""
    d = table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(3)
    return d.select(F.lit("supplier").alias("table_name"), "s_suppkey", F.concat_ws(" | ", *(F.substring(F.col(c).cast("string"), 1, 40) for c in ("s_suppkey", "s_name", "s_nationkey"))).alias("shown"))


@query("src08_catalog_columns", "SELECT table_name, lower(column_name) AS column_name FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'supplier')")
def src08_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, c.lower()) for t in ("nation", "region", "supplier") for c in table(spark, sf_dir, t).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


shared("src10_empty_tables", "SELECT 'orders' AS table_name, count(*) = 0 AS is_empty FROM (SELECT 1 AS x FROM orders LIMIT 1) t UNION ALL SELECT 'nothing', count(*) = 0 FROM (SELECT 1 AS x FROM orders WHERE o_orderkey < 0 LIMIT 1) t")
shared("snk05_chunk_sizes", "SELECT chunk, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 50) AS BIGINT) AS chunk FROM heldout_items) t GROUP BY chunk")
shared("prj01_rename", "SELECT rec_id, question AS question_original, sql AS query FROM d_retry_corrected")


@query("prj02_override", "SELECT rec_id, coalesce(question_originale, question) AS question FROM d_retry_corrected")
def prj02_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recs(spark, sf_dir).select("rec_id", "question", "question_originale").withColumn("question", F.coalesce("question_originale", "question")).drop("question_originale")


@query("prj03_chat_record", """SELECT rec_id, 3::INT AS n, 'system,user,assistant' AS roles, question, c.schema AS schema, sql AS answer FROM d_retry_corrected r JOIN db_catalogue c ON r.db_id = c.db_id""")
def prj03_chat_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records, shown by what they hold."""
    d = _recs(spark, sf_dir).select("rec_id", "db_id", "question", "sql").join(table(spark, sf_dir, "db_catalogue").select("db_id", "schema"), "db_id")
    m = d.select("rec_id", R.chat_record("Tu écris du SQL.", F.col("question"), F.col("schema"), F.col("sql")).alias("m"))
    user = F.from_json(F.col("m")[1]["content"], "question string, schema string")
    return m.select("rec_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), user["question"].alias("question"), user["schema"].alias("schema"), F.col("m")[2]["content"].alias("answer"))


@query("prj04_prompt_only", "SELECT rec_id, 2::INT AS n, false AS leaks FROM d_retry_corrected r JOIN db_catalogue c ON r.db_id = c.db_id")
def prj04_prompt_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without the gold statement."""
    d = _recs(spark, sf_dir).select("rec_id", "db_id", "question", "sql").join(table(spark, sf_dir, "db_catalogue").select("db_id", "schema"), "db_id")
    m = d.select("rec_id", "sql", F.slice(R.chat_record("Tu écris du SQL.", F.col("question"), F.col("schema"), F.col("sql")), 1, 2).alias("m"))
    return R.require(m, F.size("m") == 2, "a prompt has two messages").select("rec_id", F.size("m").alias("n"), F.coalesce(F.exists("m", lambda x: x["content"] == F.col("sql")), F.lit(False)).alias("leaks"))


@query("prj05_few_shot_messages", "SELECT rec_id, 7::INT AS n, 'system,user,assistant,user,assistant,user,assistant' AS roles FROM d_retry_corrected r JOIN db_catalogue c ON r.db_id = c.db_id")
def prj05_few_shot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _recs(spark, sf_dir).select("rec_id", "db_id", "question", "sql").join(table(spark, sf_dir, "db_catalogue").select("db_id", "schema"), "db_id")
    m = R.with_demonstrations(R.chat_record("Tu écris du SQL.", F.col("question"), F.col("schema"), F.col("sql")), [("Compte les lignes de a.", "SELECT count(*) FROM a"), ("Liste b.", "SELECT x FROM b")])
    return d.select("rec_id", m.alias("m")).select("rec_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query("prj06_drop_nulls", "SELECT rec_id, (verdict IS NOT NULL)::INT + (recheck_verdict IS NOT NULL)::INT + 1 AS fields FROM d_retry_corrected")
def prj06_drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null fields are left out of JSON."""
    return _recs(spark, sf_dir).select("rec_id", F.size(F.json_object_keys(F.to_json(F.struct("rec_id", "verdict", "recheck_verdict")))).alias("fields"))


@query("prj07_regroup", "SELECT rec_id, coalesce(verdict, '') || '>' || coalesce(recheck_verdict, '') AS path FROM d_retry_corrected")
def prj07_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _recs(spark, sf_dir).select("rec_id", F.struct(F.struct("verdict").alias("first"), F.struct(F.col("recheck_verdict").alias("verdict")).alias("second")).alias("judging"))
    return nested.select("rec_id", F.concat(F.coalesce("judging.first.verdict", F.lit("")), F.lit(">"), F.coalesce("judging.second.verdict", F.lit(""))).alias("path"))


@query("prj08_request_envelope", "SELECT 'judge:' || db_id || ':' || chunk AS custom_id, count(*) AS n, min(item_id) AS first_item FROM (SELECT db_id, item_id, (row_number() OVER (PARTITION BY db_id ORDER BY item_id) - 1) // 2 AS chunk FROM heldout_items) GROUP BY ALL")
def prj08_request_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of at most two items of a database each, with the items as a JSON payload."""
    from tamis.operators.quotas import chunks

    d = chunks(table(spark, sf_dir, "heldout_items"), 2, "item_id", by=["db_id"])
    requests = d.groupBy("db_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("item_id", "question", "sql"))).alias("items"))
    body = requests.select(F.concat_ws(":", F.lit("judge"), "db_id", "chunk").alias("custom_id"), F.to_json(F.struct("items")).alias("body"))
    items = F.from_json("body", "items array<struct<item_id:bigint>>")["items"]
    return body.select("custom_id", F.size(items).cast("bigint").alias("n"), items[0]["item_id"].alias("first_item"))


@query("prj09_numbered_prompt", """SELECT custom_id, built_at, array_to_string(list_transform(list_filter(exemplars, lambda x: x IS NOT NULL), lambda x, i: i || '. [' || coalesce(x.hardness, '') || '] ' || coalesce(x.sql, '')), E'\\n') AS prompt FROM request_meta WHERE exemplars IS NOT NULL AND len(list_filter(exemplars, lambda x: x IS NOT NULL)) > 0""")
def prj09_numbered_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.filter("exemplars", lambda x: x.isNotNull())
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.coalesce(x["hardness"], F.lit("")), F.lit("] "), F.coalesce(x["sql"], F.lit("")))
    return table(spark, sf_dir, "request_meta").where(F.size(e) > 0).select("custom_id", "built_at", F.array_join(F.transform(e, line), "\n").alias("prompt"))


@query("flt01_required_fields", "SELECT rec_id, concat_ws(',', CASE WHEN trim(coalesce(db_id, ''), E' \\t\\n') = '' THEN 'db_id' END, CASE WHEN trim(coalesce(hardness, ''), E' \\t\\n') = '' THEN 'hardness' END, CASE WHEN trim(coalesce(sql, ''), E' \\t\\n\\u200b') = '' AND trim(coalesce(sql, ''), E' \\t\\n') = '' THEN 'sql' END) AS missing FROM d_retry_corrected")
def flt01_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recs(spark, sf_dir).select("rec_id", F.array_join(R.missing_fields(["db_id", "hardness", "sql"]), ",").alias("missing"))


_ISSUES = f"""list_filter([CASE WHEN {numbers_sql('question_originale')} <> {numbers_sql('question')} THEN 'numbers' END, CASE WHEN len(regexp_extract_all(question_originale, '%')) <> len(regexp_extract_all(coalesce(question, ''), '%')) THEN 'percents' END,
CASE WHEN regexp_matches(strip_accents(coalesce(question, '')), '(?i)\\b(SELECT|FROM|WHERE|JOIN|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\\b') THEN 'holds_sql' END, CASE WHEN trim(coalesce(question, '')) <> '' AND NOT regexp_matches(question, '[A-Za-zÀ-ÖØ-öø-ÿ]') THEN 'no_letter' END], lambda x: x IS NOT NULL)"""


@query("flt02_question_checks", f"SELECT rec_id, CASE WHEN len(i) = 0 THEN 'pass' ELSE 'fail' END AS status, array_to_string(i, ',') AS issues FROM (SELECT rec_id, {_ISSUES} AS i FROM d_retry_corrected WHERE question_originale IS NOT NULL)")
def flt02_question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each corrected question against the original."""
    d = _recs(spark, sf_dir).where("question_originale IS NOT NULL")
    issues = R.question_issues(F.col("question_originale"), F.col("question"))
    return d.select("rec_id", F.when(F.size(issues) == 0, "pass").otherwise("fail").alias("status"), F.array_join(issues, ",").alias("issues"))


@query("flt03_contract", "SELECT rec_id, CASE WHEN trim(coalesce(sql, '')) = '' THEN 'blank' ELSE '' END AS violations FROM d_retry_corrected")
def flt03_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.chat_record("Tu écris du SQL.", F.col("question"), F.col("schema"), F.col("sql"))
    return _recs(spark, sf_dir).select("rec_id", F.array_join(R.contract_violations(m), ",").alias("violations"))


_LATEST = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, rec_id DESC) AS n FROM d_retry_corrected),
r AS (SELECT id, question, lower(verdict) AS verdict, CASE WHEN len(coalesce(issues, [])) = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN correction_status = 'corrected' AND recheck_verdict = 'pass' THEN question_originale END AS fix FROM d WHERE n = 1),
a AS (SELECT id, coalesce(fix, question) AS question, CASE WHEN fix IS NOT NULL THEN NULL WHEN verdict <> 'pass' THEN 'judge_' || verdict WHEN status <> 'pass' AND coalesce(verdict, '') <> 'pass' THEN 'deterministic_fail' END AS reason FROM r)
"""


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.last_wins(_recs(spark, sf_dir), ["id"], "loaded_at", "rec_id")
    checks = d.select("id", F.when(F.size(F.coalesce("issues", F.array())) == 0, "pass").otherwise("fail").alias("status"))
    judgments = d.where("verdict IS NOT NULL").select("id", F.lower("verdict").alias("verdict"))
    fixes = d.where("correction_status = 'corrected' AND recheck_verdict = 'pass' AND question_originale IS NOT NULL").select("id", F.col("question_originale").alias("question"))
    return R.accept(d.select("id", "question"), checks, judgments, fixes)


@query("flt04_accepted", _LATEST + "SELECT id, question FROM a WHERE reason IS NULL")
def flt04_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).where("reason IS NULL").select("id", "question")


@query("agg01_rejected_reasons", _LATEST + "SELECT reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY reason")
def agg01_rejected_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


shared("flt05_verdicts", "SELECT rec_id FROM d_retry_corrected WHERE lower(verdict) IN ('fail', 'uncertain')")


@query("flt06_well_formed_answers", """WITH j AS (SELECT line_id, raw::JSON AS r FROM batch_responses WHERE json_valid(raw)),
t AS (SELECT line_id, r->>'$.response.body.choices[0].message.content' AS t FROM j WHERE json_type(r->'$.response.body.choices[0].message.content') = 'VARCHAR'),
v AS (SELECT line_id, unnest((t::JSON->'$.verdicts')::JSON[]) AS v FROM t WHERE json_valid(t) AND json_type(t::JSON->'$.verdicts') = 'ARRAY')
SELECT line_id, v->>'$.id' AS id, v->>'$.verdict' AS verdict FROM v WHERE v->>'$.verdict' IN ('pass', 'fail', 'uncertain') AND v->>'$.id' IS NOT NULL""")
def flt06_well_formed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts inside chat answers, malformed ones skipped (also U8: one response, many rows)."""
    text = F.try_variant_get(F.try_parse_json("raw"), "$.response.body.choices[0].message.content", "variant")
    inner = F.try_variant_get(F.try_parse_json(F.try_variant_get(text, "$", "string")), "$.verdicts", "array<variant>")
    plain = F.when(F.schema_of_variant(text) == "STRING", inner)
    rows = table(spark, sf_dir, "batch_responses").select("line_id", F.explode(plain).alias("v"))
    return rows.select("line_id", F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.verdict", "string").alias("verdict")).where("verdict IN ('pass', 'fail', 'uncertain') AND id IS NOT NULL")


shared("flt07_selection", "SELECT rec_id, hardness FROM d_retry_corrected WHERE lower(trim(hardness)) IN ('hard', 'extra') ORDER BY rec_id LIMIT 100")
shared("flt08_runs_by_pattern", "SELECT batch_file, count(*) AS n FROM batch_responses WHERE contains(batch_file, '1') OR contains(batch_file, 'judge') GROUP BY batch_file")


@query("flt09_drop_superfluous", r"SELECT rec_id FROM d_retry_corrected WHERE sql IS NOT NULL AND NOT (len(list_filter(regexp_extract_all(lower(sql), '\bjoin\s+\w+\s+as\s+(t[0-9])\b', 1), lambda a: len(list_filter(regexp_extract_all(lower(sql), '\b(t[0-9])\.', 1), lambda b: b = a)) <= 1)) > 0 AND NOT regexp_matches(sql, '(?i)\bgroup by\b'))")
def flt09_drop_superfluous(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.functions.sqltext import superfluous_join

    return _recs(spark, sf_dir).where(F.col("sql").isNotNull() & ~superfluous_join(F.col("sql"))).select("rec_id")


@query("flt12_numeric_guard", "SELECT event_id, try_cast(props->>'$.k' AS DOUBLE) AS k FROM events WHERE try_cast(props->>'$.k' AS DOUBLE) IS NOT NULL")
def flt12_numeric_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)").alias("k")).where("k IS NOT NULL")


shared("jn01_inner_by_id", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")


@query("jn02_upsert", "SELECT db_id, coalesce(s.description, c.description) AS description FROM (SELECT db_id, description FROM db_catalogue WHERE description IS NOT NULL) c FULL JOIN (SELECT db_id, 'quota ' || target_quota AS description FROM seed_plan WHERE target_quota IS NOT NULL) s USING (db_id)")
def jn02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions told by the plan on top of the catalogue's; either side lacks some."""
    base = table(spark, sf_dir, "db_catalogue").where("description IS NOT NULL")
    planned = table(spark, sf_dir, "seed_plan").where("target_quota IS NOT NULL").select("db_id", F.concat(F.lit("quota "), "target_quota").alias("description"))
    return R.upsert(base, planned, "db_id", ["description"])


@query("jn03_paired_by_id", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def jn03_paired_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return R.paired_by_id(o.select("o_orderkey", "o_orderstatus"), o.select("o_orderkey", "o_orderpriority"), "o_orderkey")


shared("jn05_composite_key", "SELECT r.rec_id, s.target_quota FROM d_retry_corrected r JOIN seed_plan s ON r.db_id = s.db_id AND r.schema = s.schema")


@query("jn06_zip", "WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS ordinal FROM nation), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal FROM supplier) SELECT ordinal, n_name, s_name FROM a JOIN b USING (ordinal)")
def jn06_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.zipped(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["n_name"], ["s_suppkey"]).select("ordinal", "n_name", "s_name")


shared("jn07_default", "SELECT c_custkey, coalesce(max(o_orderstatus), 'missing') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY c_custkey")
shared("jn08_missing_ids", "SELECT db_id FROM db_catalogue EXCEPT SELECT db_id FROM heldout_items")


@query("jn09_restrict", "SELECT doc_id FROM documents WHERE db_id IN (SELECT db_id FROM d_retry_corrected WHERE lower(verdict) = 'uncertain')")
def jn09_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "db_id").join(_recs(spark, sf_dir).where("lower(verdict) = 'uncertain'").select("db_id"), "db_id", "left_semi").select("doc_id")


@query("jn10_failed_outputs", """WITH j AS (SELECT custom_id, max((r->>'$.response.status_code')::INT) AS status FROM (SELECT raw::JSON->>'$.custom_id' AS custom_id, raw::JSON AS r FROM batch_responses WHERE json_valid(raw)) GROUP BY 1)
SELECT m.custom_id, CASE WHEN status IS NULL THEN 'absent' WHEN status <> 200 THEN 'failed' ELSE 'ok' END AS outcome FROM (SELECT DISTINCT custom_id FROM request_meta) m LEFT JOIN j USING (custom_id)""")
def jn10_failed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("raw")
    answers = table(spark, sf_dir, "batch_responses").select(F.try_variant_get(v, "$.custom_id", "string").alias("custom_id"), F.try_variant_get(v, "$.response.status_code", "int").alias("status")).groupBy("custom_id").agg(F.max("status").alias("status"))
    d = table(spark, sf_dir, "request_meta").select("custom_id").distinct().join(answers, "custom_id", "left")
    return d.select("custom_id", F.when(F.col("status").isNull(), "absent").when(F.col("status") != 200, "failed").otherwise("ok").alias("outcome"))


@query("jn11_id_differences", "SELECT count(*) FILTER (b.id IS NULL) AS missing, count(*) FILTER (a.id IS NULL) AS extra FROM (SELECT DISTINCT id FROM d_retry_corrected WHERE recheck_verdict IS NOT NULL) a FULL JOIN (SELECT DISTINCT id FROM d_retry_corrected WHERE verdict IS NOT NULL) b ON a.id = b.id")
def jn11_id_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-checked records against judged ones."""
    d = _recs(spark, sf_dir).select("id", "verdict", "recheck_verdict")
    return R.id_differences(d.where("recheck_verdict IS NOT NULL"), d.where("verdict IS NOT NULL"), "id")


@query("jn12_ordered_upsert", "SELECT rec_id, CASE WHEN correction_status IS NOT NULL THEN question ELSE coalesce(question_originale, question) END AS question, row_number() OVER (ORDER BY rec_id) AS place FROM d_retry_corrected")
def jn12_ordered_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected questions on top of the original ones, in order."""
    d = _recs(spark, sf_dir).select("rec_id", "question", "question_originale", "correction_status")
    base = d.select("rec_id", F.coalesce("question_originale", "question").alias("question"))
    return ranked(R.upsert(base, d.where("correction_status IS NOT NULL"), "rec_id", ["question"]), [F.col("rec_id")]).withColumnRenamed("position", "place")


@query("jn13_rounds", """WITH u AS (SELECT id, question_originale AS question, lower(verdict) AS verdict, 0 AS round FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) n FROM d_retry_corrected) WHERE n = 1
UNION ALL SELECT id, question, recheck_verdict, 1 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) n FROM d_retry_corrected) WHERE n = 1)
SELECT id, arg_max(question, round) FILTER (question IS NOT NULL) AS question, max(round) AS round FROM u WHERE verdict = 'pass' GROUP BY id""")
def jn13_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.last_wins(_recs(spark, sf_dir), ["id"], "rec_id")
    first = d.select("id", F.col("question_originale").alias("question"), F.lower("verdict").alias("verdict"))
    return R.merged_rounds([first, d.select("id", "question", F.col("recheck_verdict").alias("verdict"))], "id", "question").withColumn("question", F.col("question"))


shared("jn14_dimension", "SELECT doc_id, description FROM documents d JOIN db_catalogue c ON d.db_id = c.db_id WHERE description IS NOT NULL")
shared("jn15_attributes", "SELECT h.doc_id, s.source_examples FROM documents h JOIN seed_plan s ON h.db_id = s.db_id")


@query("jn16_bucket_index", "WITH e AS (SELECT custom_id, built_at, unnest(range(len(exemplars) * 2 + 1)) AS i, len(exemplars) AS n FROM request_meta WHERE len(exemplars) > 0) SELECT custom_id, built_at, i::INT AS example, least(i // 2, n - 1)::INT AS exemplar FROM e")
def jn16_bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "request_meta").where("size(exemplars) > 0").select("custom_id", "built_at", F.size("exemplars").alias("n"), F.explode(F.sequence(F.lit(0), F.size("exemplars") * 2)).alias("example"))
    return d.select("custom_id", "built_at", "example", F.least(F.floor(F.col("example") / 2), F.col("n") - 1).cast("int").alias("exemplar"))


@query("jn17_other_databases", "SELECT c.db_id, (SELECT count(*) FROM heldout_items) - count(h.item_id) AS others FROM db_catalogue c LEFT JOIN heldout_items h ON h.db_id = c.db_id GROUP BY c.db_id")
def jn17_other_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exemplars other databases offer: all less one's own, so no theta join is needed."""
    items = table(spark, sf_dir, "heldout_items")
    own = items.groupBy("db_id").agg(F.count("*").alias("own"))
    total = items.agg(F.count("*").alias("all"))
    d = table(spark, sf_dir, "db_catalogue").select("db_id").join(own, "db_id", "left").join(F.broadcast(total))
    return d.select("db_id", (F.col("all") - F.coalesce("own", F.lit(0))).alias("others"))


shared("jn18_run_pairs", "SELECT a.t AS base, b.t AS candidate FROM (SELECT DISTINCT event_type AS t FROM events) a JOIN (SELECT DISTINCT event_type AS t FROM events) b ON a.t < b.t")
shared("jn19_foreign_keys", "SELECT 'lineitem' AS child, count(*) AS orphans FROM lineitem LEFT ANTI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'customer', count(*) FROM customer LEFT ANTI JOIN nation ON c_nationkey = n_nationkey")
ORACLE["jn19_foreign_keys"] = "SELECT 'lineitem' AS child, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)"


@query("jn20_judge_agreement", """SELECT count(*) AS n, count(*) FILTER (lower(verdict) <> 'pass' AND recheck_verdict <> 'pass') AS both_reject, count(*) FILTER (lower(verdict) <> 'pass' AND recheck_verdict = 'pass') AS first_only, count(*) FILTER (lower(verdict) = 'pass' AND recheck_verdict <> 'pass') AS second_only FROM d_retry_corrected WHERE verdict IS NOT NULL AND recheck_verdict IS NOT NULL""")
def jn20_judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _recs(spark, sf_dir)
    a, b = d.where("verdict IS NOT NULL").select("rec_id", (F.lower("verdict") != "pass").alias("x")), d.where("recheck_verdict IS NOT NULL").select("rec_id", (F.col("recheck_verdict") != "pass").alias("y"))
    return a.join(b, "rec_id").agg(F.count("*").alias("n"), F.count_if(F.col("x") & F.col("y")).alias("both_reject"), F.count_if(F.col("x") & ~F.col("y")).alias("first_only"), F.count_if(~F.col("x") & F.col("y")).alias("second_only"))


@query("win01_keep_first", "SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY db_id, question, sql ORDER BY rec_id) AS n FROM d_retry_corrected) WHERE n = 1")
def win01_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_first(_recs(spark, sf_dir).select("rec_id", "db_id", "question", "sql"), ["db_id", "question", "sql"], "rec_id").select("rec_id")


@query("win02_greedy_accept", r"""WITH k AS (SELECT rec_id, regexp_replace(replace(lower(regexp_replace(question, '[\s\x{00A0}\x{202F}]+', ' ', 'g')), 'ß', 'ss'), '^[ .?!…]+|[ .?!…]+$', '', 'g') AS k, length(question) >= 180 AS l, coalesce(regexp_matches(sql, '(?i)^\s*(select|with)\b'), false) AS v FROM d_retry_corrected),
f AS (SELECT *, min(rec_id) FILTER (l AND v) OVER (PARTITION BY k) AS f FROM k)
SELECT rec_id, CASE WHEN NOT l THEN 'too_short' WHEN rec_id > f THEN 'duplicate' WHEN NOT v THEN 'sql_not_read_only' END AS reason FROM f""")
def win02_greedy_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.functions.sqltext import guard_checker

    valid = F.coalesce(guard_checker(F.col("sql")), F.lit(False))
    return R.greedy_accept(_recs(spark, sf_dir).select("rec_id", "question", "sql"), question_key(F.col("question")), F.length("question") >= 180, valid, F.lit("sql_not_read_only"), "rec_id").select("rec_id", "reason")


@query("win03_two_key_accept")
def win03_two_key_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each choice depends on the ones before: tested against brute force."""
    d = _recs(spark, sf_dir).where("db_id IS NOT NULL AND sql IS NOT NULL").select("rec_id", "db_id", "question", "sql")
    return R.two_key_accept(d, "db_id", F.lower("question"), F.lower("sql"), ["rec_id"]).select("rec_id")


@query("win13_last_wins", "SELECT id, arg_max(rec_id, rec_id) AS rec_id FROM d_retry_corrected GROUP BY id")
def win13_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_wins(_recs(spark, sf_dir).select("id", "rec_id"), ["id"], "rec_id")


shared("set01_union_all", "SELECT item_id AS key, question FROM heldout_items UNION ALL SELECT rec_id, question FROM d_retry_corrected")


@query("set02_fingerprint_union", """WITH n AS (SELECT question, sql, row_number() OVER (PARTITION BY question, sql ORDER BY rec_id) AS n FROM d_retry_corrected)
SELECT question, sql, 'base' AS origin FROM heldout_items UNION ALL SELECT question, sql, 'added' FROM n WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM heldout_items h WHERE h.question = n.question AND h.sql = n.sql)""")
def set02_fingerprint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fingerprint_union(table(spark, sf_dir, "heldout_items"), _recs(spark, sf_dir), ["question", "sql"], "rec_id")


@query("fn18_fingerprint", "SELECT item_id, sha256('{\"db_id\":\"' || db_id || '\",\"id\":\"' || id || '\"}') AS fingerprint FROM heldout_items")
def fn18_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "heldout_items").select("item_id", R.fingerprint("id", "db_id").alias("fingerprint"))


shared("set03_difference", "SELECT id FROM d_retry_corrected WHERE lower(verdict) = 'fail' EXCEPT SELECT id FROM d_retry_corrected WHERE recheck_verdict = 'pass'")
shared("set04_intersection", "SELECT id FROM d_retry_corrected WHERE lower(verdict) = 'fail' INTERSECT SELECT id FROM d_retry_corrected WHERE recheck_verdict = 'fail'")


@query("set05_subset_test", "SELECT (SELECT count(*) FROM (SELECT db_id FROM heldout_items EXCEPT SELECT db_id FROM db_catalogue)) = 0 AS is_subset")
def set05_subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "heldout_items").select("db_id").join(table(spark, sf_dir, "db_catalogue").select("db_id"), "db_id", "left_anti")
    return left.agg((F.count("*") == 0).alias("is_subset"))


shared("set06_bag_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey EXCEPT ALL SELECT l_suppkey, sum(1) AS n FROM lineitem GROUP BY l_suppkey) UNION ALL (SELECT l_suppkey, sum(1) AS n FROM lineitem GROUP BY l_suppkey EXCEPT ALL SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)) t")


@query("set07_append_unique", "SELECT rec_id, array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), '|') AS all_issues FROM (SELECT rec_id, list_concat(coalesce(issues, []), coalesce(recheck_issues, [])) AS l FROM d_retry_corrected)")
def set07_append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recs(spark, sf_dir).select("rec_id", F.array_join(F.array_union(F.coalesce("issues", F.array()), F.coalesce("recheck_issues", F.array())), "|").alias("all_issues"))


@query("srt01_composite_sort", "SELECT id, rec_id, row_number() OVER (ORDER BY split_part(id, ':', 2), CAST(split_part(id, ':', 4) AS INT), id, rec_id) AS place FROM d_retry_corrected")
def srt01_composite_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an id in order, numbers as numbers; places are given without one task for all rows."""
    p = F.split("id", ":")
    return ranked(_recs(spark, sf_dir).select("id", "rec_id"), [p[1], p[3].cast("int"), F.col("id"), F.col("rec_id")]).withColumnRenamed("position", "place")


shared("srt05_top_k", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")


@query("srt07_error_listing", "SELECT count(*) AS total, array_to_string(list_sort(list(rec_id))[1:20], ',') AS first_ids FROM d_retry_corrected WHERE lower(verdict) = 'uncertain'")
def srt07_error_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total and the first twenty, found by a top-k, not by gathering all."""
    bad = _recs(spark, sf_dir).where("lower(verdict) = 'uncertain'").select("rec_id")
    first = bad.orderBy("rec_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("rec_id")).cast("array<string>"), ",").alias("first_ids"))
    return bad.agg(F.count("*").alias("total")).crossJoin(F.broadcast(first))
