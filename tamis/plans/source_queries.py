"""Queries of sources and sinks: what is written is read back and must be the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.session import shared_dir, table
from tamis.sources import jsonl, sinks
from tamis.sources.gpu import gpu_stats
from tamis.sources.jobs import Jobs
from tamis.sources.paged import PagedSource, available, local, write_pages
from tamis.sources.sqlite import SqliteSource, inspect, sample_text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tamis/{name}-{uuid.uuid4().hex}"


_RECORD = "rec_id bigint, id string, question string, sql string, issues array<string>"


@query("src01_json_lines", "SELECT rec_id, id, question, sql, array_to_string(issues, '|') AS issues FROM d_retry_corrected")
def src01_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines, null fields left out, and read back with their schema."""
    path = _folder(spark, "lines")
    sinks.write_jsonl(table(spark, sf_dir, "d_retry_corrected").select("rec_id", "id", "question", "sql", "issues"), path)
    return jsonl.read_jsonl(spark, path, _RECORD, strict=True).withColumn("issues", F.array_join("issues", "|"))


@query("src02_json_document", "SELECT db_id, source_examples, target_quota FROM seed_plan")
def src02_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planning table as one JSON document, a list, read as a whole."""
    rows = table(spark, sf_dir, "seed_plan").agg(F.to_json(F.array_sort(F.collect_list(F.struct("db_id", "source_examples", "target_quota")))).alias("value"))  # a row a database
    path = _folder(spark, "document")
    rows.write.text(path)
    return jsonl.read_json_array(spark, path, "db_id string, source_examples int, target_quota int")


@query("src03_line_numbers", "SELECT 'dev:' || (row_number() OVER (ORDER BY item_id) - 1) AS id, item_id, question FROM heldout_items")
def src03_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out items as one file, each with the number of its line."""
    path = _folder(spark, "items")
    sinks.write_jsonl(table(spark, sf_dir, "heldout_items").select("item_id", "question").coalesce(1).sortWithinPartitions("item_id"), path, files=1)
    return jsonl.read_with_ordinal(spark, path, "item_id bigint, question string", "dev")


@query("src04_optional_input", "SELECT item_id, NULL::VARCHAR AS note FROM heldout_items")
def src04_optional_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input that isn't there is an empty table."""
    notes = jsonl.read_optional(spark, _folder(spark, "missing"), "item_id bigint, note string")
    return table(spark, sf_dir, "heldout_items").select("item_id").join(notes, "item_id", "left")


@query("src05_many_files", "SELECT doc_id, source AS chunk FROM documents")
def src05_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in a folder a source, read as one table that knows each file's folder."""
    path = _folder(spark, "chunks")
    sinks.write_chunked(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("chunk")), path)
    rows = spark.read.schema("doc_id bigint").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select("doc_id", F.url_decode(F.regexp_extract("_metadata.file_path", "chunk=([^/]+)/", 1)).alias("chunk"))


def _sqlite(spark: SparkSession, sf_dir: str) -> str:
    """The fixed-size tables as an SQLite file in the shared folder, which executors must see under the same path."""
    path = local(_folder(spark, "sqlite"))
    path.parent.mkdir(parents=True, exist_ok=True)
    ddl = ["CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)", "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER REFERENCES region(r_regionkey))", "CREATE TABLE unfilled (a TEXT)"]
    rows = [f"INSERT INTO {t} VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in table(spark, sf_dir, t).select(*c).orderBy(c[0]).collect()) for t, c in (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]))]
    sinks.build_sqlite(str(path), ddl, rows, tables=(1, 8), least_rows=0)
    return str(path)


@query("src07_sqlite_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def src07_sqlite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", _sqlite(spark, sf_dir)).option("dbtable", "nation").load()


@query("src09_database_scan", "SELECT * FROM (VALUES ('good', true, 'nation', 'n_nationkey,n_name,n_regionkey', false), ('good', true, 'unfilled', 'a', true), ('good', true, 'region', 'r_regionkey,r_name', false), ('gone', false, NULL, NULL, NULL)) t(db_id, ok, table_name, columns, is_empty)")
def src09_database_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity, tables, columns and emptiness of databases; one that is missing is told."""
    path = _sqlite(spark, sf_dir)
    found = inspect(spark.createDataFrame([("good", path), ("gone", path + "-gone")], "db_id string, path string"))
    return found.select("db_id", "ok", "table_name", F.array_join("columns", ",").alias("columns"), "is_empty")


@query("src06_sqlite_sample", "SELECT string_agg(x, chr(10) ORDER BY x) AS shown FROM (SELECT 'region: r_regionkey | r_name' AS x UNION ALL SELECT r_regionkey || ' | ' || r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'nation: n_nationkey | n_name | n_regionkey' UNION ALL SELECT n_nationkey || ' | ' || n_name || ' | ' || n_regionkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'unfilled: a')")
def src06_sqlite_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each table of a database as text; lines sorted."""
    return spark.createDataFrame([("\n".join(sorted(sample_text(_sqlite(spark, sf_dir)).splitlines())),)], "shown string")


@query("src13_gpu_lines", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS load, round(l_discount::DOUBLE * 100, 2) AS watts, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber::DOUBLE END AS temp FROM lineitem")
def src13_gpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor lines with units and missing values; the numbers of the line items stand in for a monitor's."""
    number = lambda c: F.format_string("%.2f", c)
    line = F.concat_ws(", ", F.concat(number(F.col("l_quantity").cast("double")), F.lit(" %")), F.concat(number(F.col("l_discount").cast("double") * 100), F.lit(" W")), F.when(F.col("l_returnflag") == "N", "[N/A]").otherwise(F.col("l_linenumber").cast("string")))
    return gpu_stats(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")), "line", ["load", "watts", "temp"])


@query("src14_paged_listing", "SELECT item_id, db_id FROM heldout_items")
def src14_paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out items as pages linked by tokens."""
    folder = _folder(spark, "pages")
    write_pages(table(spark, sf_dir, "heldout_items").select("item_id", "db_id"), folder, 50, "item_id")
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").schema("item_id bigint, db_id string").option("path", folder).load()


@query("src15_batch_jobs", "SELECT batch_file AS job, 'completed' AS state, count(*) AS lines, count_if(json_valid(raw))::BIGINT AS valid FROM batch_responses GROUP BY batch_file")
def src15_batch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files as jobs: submitted, answered by file drops, polled until all have ended, downloaded."""
    jobs = Jobs(spark, _folder(spark, "jobs"))
    lines = table(spark, sf_dir, "batch_responses").select("batch_file", "line_id", "raw")
    jobs.submit(lines.select("batch_file", "line_id"), "batch_file")

    def serve() -> None:
        lines.select(F.col("batch_file").alias("job"), "line_id", "raw").write.mode("overwrite").partitionBy("job").json(f"{jobs.folder}/answers")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for r in jobs.states().select("job").collect():
            p = hadoop.Path(f"{jobs.folder}/answers/job={r['job']}/_SUCCESS")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p).close()

    jobs.wait(every=0.1, most=600, between=serve)
    got = jobs.download("line_id bigint, raw string").groupBy("job").agg(F.count("*").alias("lines"), F.count_if(F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit(",0]"))), "$", "array<variant>")) == 2).alias("valid"))
    return jobs.states().select("job", "state").join(got, "job", "left")


@query("flt14_available_types", "SELECT p_type, count(*) AS n, bool_or(p_size > 49) AS available FROM part WHERE regexp_matches(p_type, '^(S|MED)') GROUP BY p_type")
def flt14_available_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that match a pattern, those available first."""
    types = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.max((F.col("p_size") > 49).cast("int")).alias("big"))
    return available(types, "p_type", "^(S|MED)", F.col("big") == 1).drop("big")


@query("snk02_manifest", "SELECT count(*) AS records, count(DISTINCT id) AS ids, max(rec_id) AS last FROM d_retry_corrected")
def snk02_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row as pretty JSON, read back."""
    one = table(spark, sf_dir, "d_retry_corrected").agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"), F.max("rec_id").alias("last"))
    text = sinks.manifest(one)
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "records bigint, ids bigint, last bigint").alias("m")).select("m.*")


@query("snk03_append_log", "SELECT source, 2 * count(*) AS n FROM documents GROUP BY source")
def snk03_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended to twice."""
    path = _folder(spark, "log")
    for _ in range(2):
        sinks.append_log(table(spark, sf_dir, "documents").select("source"), path)
    return jsonl.read_jsonl(spark, path, "source string").groupBy("source").agg(F.count("*").alias("n"))


@query("snk04_no_overwrite", "SELECT true AS refused, count(*) AS kept FROM nation")
def snk04_no_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that is there already is refused and stays as it was."""
    path, nation = _folder(spark, "once"), table(spark, sf_dir, "nation").select("n_name")
    sinks.write_jsonl(nation, path, overwrite=False)
    try:
        sinks.write_jsonl(nation.limit(1), path, overwrite=False)
        refused = False
    except Exception as e:
        refused = "already exist" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    return jsonl.read_jsonl(spark, path, "n_name string").agg(F.lit(refused).alias("refused"), F.count("*").alias("kept"))


@query("snk07_report", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT '| r_regionkey | r_name |' UNION ALL SELECT '| --- | --- |'")
def snk07_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded table as Markdown, by line."""
    text = sinks.report(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query("snk08_fingerprints", "SELECT item_id, sha256(item_id || ':' || question) AS sha256 FROM heldout_items")
def snk08_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an item, told by the SHA-256 of its bytes; the files' names are the items' numbers."""
    folder = local(_folder(spark, "files"))
    folder.mkdir(parents=True)
    for r in table(spark, sf_dir, "heldout_items").select("item_id", "question").toLocalIterator():  # the held-out items are few at every scale
        (folder / f"{r['item_id']}.txt").write_text(f"{r['item_id']}:{r['question']}", "utf-8")
    return sinks.fingerprints(spark, f"file://{folder}").select(F.regexp_extract("file_name", "^[0-9]+", 0).cast("bigint").alias("item_id"), "sha256")
