import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tamis.operators.compare import _columns_match, bags_equal, cell, strictly_equal
from tamis.operators.execute import check_statements, execute_built, execute_spark, execute_sqlite, run_sqlite, score
from tamis.sources import jsonl, sinks
from tamis.sources.gpu import gpu_stats
from tamis.sources.jobs import Jobs
from tamis.sources.paged import PagedSource, write_pages
from tamis.sources.sqlite import SqliteSource, inspect, sample_text
from tamis.streaming.sampler import Sampler


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "d.sqlite")
    tables = [f"CREATE TABLE t{i} (id INTEGER PRIMARY KEY, name TEXT, x REAL)" for i in range(4)]
    rows = [f"INSERT INTO t{i} VALUES {', '.join(f'({j}, ' + chr(39) + f'n{j}' + chr(39) + f', {j}.5)' for j in range(12))}" for i in range(4)]
    sinks.build_sqlite(path, tables, rows)
    return path


def test_cells_and_equalities(spark):
    assert [cell(x) for x in (None, 1, 1.0, "a", b"\x01", True)] == ["n", "i:1", "r:1.0", "t:a", "b:01", "i:1"]
    rows = [([["i:1"], ["i:2"]], [["r:1.0"], ["i:2"]]), ([["i:1"], ["i:2"]], [["i:2"], ["i:1"]]), ([], []), (None, [])]
    df = spark.createDataFrame(rows, "a array<array<string>>, b array<array<string>>")
    got = df.select(strictly_equal(F.col("a"), F.col("b")).alias("s"), bags_equal(F.col("a"), F.col("b"), F.lit(False)).alias("u"), bags_equal(F.col("a"), F.col("b"), F.lit(True)).alias("o")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (True, True, True), (False, False, False)]
    assert _columns_match([["1", "x"], ["2", "y"]], [["y", "2"], ["x", "1"]], False)
    assert not _columns_match([["1", "x"]], [["x", "2"]], False) and not _columns_match([], [], False)
    assert not _columns_match([list("abcdefg")], [list("bacdefg")], False)  # wider than six columns


def test_sqlite_execution_and_scores(spark, database):
    assert run_sqlite(database, "SELECT count(*) FROM t0") == (True, [["i:12"]], None)
    assert run_sqlite(database, "DELETE FROM t0")[2] == "not read-only"
    assert "no such column" in run_sqlite(database, "SELECT z FROM t0")[2]
    slow = "WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r) SELECT count(*) FROM r"
    assert run_sqlite(database, slow, timeout=0.2)[2].startswith("timeout")
    pairs = [("1", "SELECT id FROM t0", "SELECT id FROM t0"), ("2", "SELECT name, id FROM t0", "SELECT id, name FROM t0"), ("3", "SELECT z FROM t0", "SELECT id FROM t0"), ("4", "SELECT id FROM t0 ORDER BY id DESC", "SELECT id FROM t0"), ("5", None, "SELECT id FROM t0")]
    p = spark.createDataFrame([(i, "d", s) for i, s, _ in pairs], "id string, db_id string, sql string")
    g = spark.createDataFrame([(i, s) for i, _, s in pairs], "id string, sql string")
    results = execute_sqlite(p.select("db_id", "sql").union(g.select(F.lit("d"), "sql")), lambda _: database)
    got = {r["id"]: (r["strict"], r["bag"], r["permuted"], r["executed"]) for r in score(p, g, results).collect()}
    assert got["1"] == (True, True, True, True) and got["2"] == (False, False, True, True) and got["3"] == (False, False, False, False)
    assert got["4"] == (False, True, True, True) and not got["5"][3]
    assert all(a <= b <= c for a, b, c, _ in got.values())


def test_sqlite_source_and_catalog(spark, database, tmp_path):
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", database).option("dbtable", "t1").load()
    assert df.count() == 12 and dict(df.dtypes) == {"id": "bigint", "name": "string", "x": "double"}
    broken = tmp_path / "no.sqlite"
    broken.write_bytes(b"not a database at all, but long enough to be read as one" * 40)
    paths = spark.createDataFrame([("d", database), ("gone", str(tmp_path / "gone.sqlite")), ("bad", str(broken))], "db_id string, path string")
    got = inspect(paths).collect()
    assert {r["table_name"] for r in got if r["db_id"] == "d"} == {"t0", "t1", "t2", "t3"} and not any(r["ok"] for r in got if r["db_id"] != "d")
    assert sample_text(database).splitlines()[1] == "0 | n0 | 0.5"


def test_sqlite_policy(tmp_path):
    with pytest.raises(sinks.PolicyError):
        sinks.build_sqlite(str(tmp_path / "a.sqlite"), ["DROP TABLE x"], [])
    with pytest.raises(sinks.PolicyError):
        sinks.build_sqlite(str(tmp_path / "b.sqlite"), ["CREATE TABLE x (a INT)"], [])
    assert not (tmp_path / "b.sqlite").exists()
    with pytest.raises(sqlite3.Error):
        sinks.build_sqlite(str(tmp_path / "c.sqlite"), ["CREATE TABLE x"], [])
    for insert in ("INSERT INTO x SELECT load_extension('y')", "INSERT INTO x SELECT * FROM pragma_database_list", "INSERT INTO x VALUES (1) ON CONFLICT DO UPDATE SET a = 2"):
        with pytest.raises(sqlite3.Error):  # what the first words don't show
            sinks.build_sqlite(str(tmp_path / "d.sqlite"), ["CREATE TABLE x (a INT PRIMARY KEY)"], [insert], tables=(1, 1), least_rows=0)
    assert not (tmp_path / "d.sqlite").exists()


def test_json_files(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 2}\n{"a": broken\n', encoding="utf-8")
    assert sorted(r["a"] for r in jsonl.read_jsonl(spark, str(f), "a int").collect() if r["a"]) == [1, 2]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(f), "a int", strict=True).collect()
    assert [tuple(r) for r in jsonl.read_with_ordinal(spark, str(f), "a int", "dev").orderBy("id").collect()][:2] == [("dev:0", 1), ("dev:1", 2)]
    g = tmp_path / "b.json"
    g.write_text('[{"a": 1},\n {"a": 2}]', encoding="utf-8")
    assert jsonl.read_json_array(spark, str(g), "a int").count() == 2
    assert jsonl.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("é", None), ("b", 1)], "a string, n int")
    sinks.write_jsonl(df, out, files=1)
    assert sorted(jsonl.read_many(spark, [out], "a string, n int", "*.json").select("a").collect()) == [("b",), ("é",)]
    with pytest.raises(Exception):
        sinks.write_jsonl(df, out, overwrite=False)
    sinks.append_log(df, out)
    assert jsonl.read_jsonl(spark, out, "a string").count() == 4
    assert sinks.fingerprints(spark, out).where("length(sha256) = 64").count() >= 2
    assert '"n" : 2' in sinks.manifest(df.agg(F.count("*").alias("n"))) and sinks.report(df).count("|") > 6


def test_light_check_and_gold(spark, database):
    ddl = "CREATE TABLE t (a INT, b TEXT);"
    rows = [(1, "SELECT a FROM t", ddl), (2, "DELETE FROM t", ddl), (3, "SELECT z FROM t", ddl), (4, "SELECT a FROM t WHERE a IN (1, 2)", ddl), (5, "SELECT a FROM t", None), (6, None, ddl), (7, "SELECT a FROM t", "no ddl")]
    got = {r["k"]: (r["reason"], r["hardness"]) for r in check_statements(spark.createDataFrame(rows, "k int, s string, d string"), "k", "s", "d").collect()}
    assert got == {1: (None, "easy"), 2: ("sql_not_read_only", None), 3: ("sql_execution_error", None), 4: ("spider_parse_error", None), 5: ("database_missing", None), 6: ("sql_not_read_only", None), 7: ("database_missing", None)}
    p = spark.createDataFrame([("1", "d", "SELECT id FROM t0")], "id string, db_id string, sql string")
    g = spark.createDataFrame([("1", "SELECT z FROM t0")], "id string, sql string")
    with pytest.raises(ValueError, match="gold"):
        score(p, g, execute_sqlite(p.union(g.select("id", F.lit("d"), "sql")), lambda _: database), strict_gold=True)


def test_gpu_lines(spark):
    df = spark.createDataFrame([("a", "12 %, 300.5 W, [N/A]"), ("b", "7"), ("c", None)], "host string, line string")
    got = {r["host"]: (r["load"], r["watts"], r["temp"]) for r in gpu_stats(df, "line", ["load", "watts", "temp"]).collect()}
    assert got == {"a": (12.0, 300.5, None), "b": (7.0, None, None), "c": (None, None, None)}


def test_large_results_are_compared_whole(spark):
    one = "SELECT id, id % 7 AS m FROM range(0, 30, 1, 3)"
    pairs = [
        (one, "SELECT id, IF(id = 29, 99, id % 7) AS m FROM range(0, 30, 1, 3)", (False, False, False)),  # differs beyond the bound
        (one, "SELECT id * 1.0D AS id, id % 7 AS m FROM range(0, 30, 1, 3)", (True, True, True)),
        (one, one + " ORDER BY id DESC", (False, False, False)), (one + " ORDER BY id DESC", one, (False, True, True)),
        ("SELECT id % 7 AS m, id FROM range(0, 30, 1, 3)", one, (False, False, True)), (one + " LIMIT 5", one, (False, False, False)), (one, one, (True, True, True)),
    ]
    p = spark.createDataFrame([(str(i), "d", a) for i, (a, _, _) in enumerate(pairs)], "id string, db_id string, sql string")
    g = spark.createDataFrame([(str(i), b) for i, (_, b, _) in enumerate(pairs)], "id string, sql string")
    results = execute_spark(spark, [("d", s) for s in sorted({s for a, b, _ in pairs for s in (a, b)})], most_rows=10)
    got = {r["id"]: (r["strict"], r["bag"], r["permuted"]) for r in score(p, g, results).collect()}
    assert got == {str(i): w for i, (_, _, w) in enumerate(pairs)}


def test_built_databases(spark):
    databases = spark.createDataFrame([("a", "CREATE TABLE t (x INT); INSERT INTO t VALUES (1), (2);"), ("b", "CREATE TABLE broken ("), ("c", None)], "db_id string, script string")
    asked = spark.createDataFrame([("a", "SELECT sum(x) FROM t"), ("a", "SELECT x FROM t"), ("a", "SELECT y FROM t"), ("a", "DROP TABLE t"), ("b", "SELECT 1"), ("c", "SELECT 1"), ("d", "SELECT 1"), ("a", None)], "db_id string, sql string")
    got = {(r["db_id"], r["sql"]): (r["ok"], r["rows"]) for r in execute_built(asked.union(asked).repartition(3), databases).collect()}
    assert len(got) == 8 and got["a", "SELECT sum(x) FROM t"] == (True, [["i:3"]]) and got["a", "SELECT x FROM t"] == (True, [["i:1"], ["i:2"]])
    assert sum(ok for ok, _ in got.values()) == 2


def test_jobs_go_on_where_they_stopped(spark, tmp_path):
    requests = spark.createDataFrame([("j1", 1), ("j1", 2), ("j2", 3), (None, 4)], "name string, n int")
    jobs = Jobs(spark, f"file://{tmp_path}/jobs")
    assert jobs.states().count() == 0 and jobs.submit(requests, "name") == ["j1", "j2"] and jobs.submit(requests, "name") == []
    assert jobs.poll() == {"j1": "running", "j2": "running"} and jobs.download("n int").count() == 0
    done = tmp_path / "jobs" / "answers" / "job=j1"
    done.mkdir(parents=True)
    (done / "a.json").write_text('{"n": 10}\n{"n": 20}\n')
    assert jobs.poll()["j1"] == "running"  # not complete yet
    (done / "_SUCCESS").touch()
    (tmp_path / "jobs" / "failed").mkdir()
    (tmp_path / "jobs" / "failed" / "j2").write_text("quota")
    again = Jobs(spark, f"file://{tmp_path}/jobs")  # another driver
    assert again.wait(every=0.01, most=60) == {"j1": "completed", "j2": "failed"}
    assert sorted(tuple(r) for r in again.download("n int").select("job", "n").collect()) == [("j1", 10), ("j1", 20)]
    assert {r["job"]: (r["step"], r["reason"]) for r in again.states().collect()} == {"j1": (2, None), "j2": (2, "quota")}
    with pytest.raises(TimeoutError):
        again.submit(requests.replace("j1", "j3", "name"), "name") and again.wait(every=0.01, most=0)


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f"x{i}") for i in range(23)], "i int, s string")
    assert write_pages(df, str(tmp_path / "p"), 5, "i") == 5 and write_pages(df.limit(0), str(tmp_path / "q"), 5, "i") == 1
    spark.dataSource.register(PagedSource)
    read = lambda at: spark.read.format("pages").schema("i int, s string").option("path", str(tmp_path / at)).load()
    assert sorted(map(tuple, read("p").collect())) == sorted(map(tuple, df.collect())) and read("q").count() == 0
    (tmp_path / "p" / "page-4.json").write_text('{"items": [], "next": "first"}')
    with pytest.raises(Exception, match="twice"):
        read("p").count()


def test_sampler():
    with Sampler(lambda: 1 / 0 if len(s.samples) == 1 else "v", every=0.01, most=3) as s:
        time.sleep(0.2)
    assert len(s.samples) == 3 and all(v == "v" for _, v in s.samples)
    n = s.samples[-1][0]
    time.sleep(0.05)
    assert s.samples[-1][0] == n
