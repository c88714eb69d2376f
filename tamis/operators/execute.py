"""Read-only execution of SQL text: over Spark views, and over many small SQLite files inside Arrow batches."""

from __future__ import annotations

import re
import sqlite3
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.compare import MOST_COLUMNS, cell, unified
from tamis.session import materialize

TIMEOUT_S = 5.0
RESULT = "db_id string, sql string, ok boolean, rows array<array<string>>, error string, ms double"
_ARROW = pa.schema([("db_id", pa.string()), ("sql", pa.string()), ("ok", pa.bool_()), ("rows", pa.list_(pa.list_(pa.string()))), ("error", pa.string()), ("ms", pa.float64())])


def read_only(sql: str | None) -> bool:
    s = (sql or "").lstrip().upper()
    return s.startswith(("SELECT ", "WITH ", "SELECT\n", "WITH\n")) or s in ("SELECT", "WITH")


def run_on(db: sqlite3.Connection, sql: str | None, timeout: float = TIMEOUT_S, most_rows: int | None = None) -> tuple[bool, list[list[str]] | None, str | None]:
    """(ok, tagged rows, error) of one statement; bad UTF-8 is replaced."""
    if not read_only(sql):
        return False, None, "not read-only"
    try:
        db.text_factory = lambda raw: raw.decode("utf-8", "replace")
        db.execute("PRAGMA query_only = ON")
        until = time.monotonic() + timeout
        db.set_progress_handler(lambda: time.monotonic() > until, 1000)
        cursor = db.execute(sql)
        rows = cursor.fetchall() if most_rows is None else cursor.fetchmany(most_rows)
        return True, [[cell(x) for x in r] for r in rows], None
    except (sqlite3.Error, sqlite3.Warning) as e:
        return False, None, f"timeout after {timeout:g} s" if "interrupt" in str(e).lower() else str(e)


def run_sqlite(path: str, sql: str | None, timeout: float = TIMEOUT_S, most_rows: int | None = None) -> tuple[bool, list[list[str]] | None, str | None]:
    """The same on a file, opened read-only."""
    if not read_only(sql):
        return False, None, "not read-only"
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    except sqlite3.Error as e:
        return False, None, str(e)
    try:
        return run_on(db, sql, timeout, most_rows)
    finally:
        db.close()


def _outcomes(dbs: list, sqls: list, run: Callable) -> Iterator[pa.RecordBatch]:
    """Results in batches of bounded size, since a statement may give many rows."""
    out, cells = [], 0
    for db, sql in zip(dbs, sqls, strict=True):
        began = time.monotonic()
        ok, rows, error = run(db, sql)
        out.append({"db_id": db, "sql": sql, "ok": ok, "rows": rows, "error": error, "ms": round((time.monotonic() - began) * 1000, 2)})
        cells += sum(map(len, rows or ()))
        if cells > 1_000_000:
            yield from pa.Table.from_pylist(out, _ARROW).to_batches()
            out, cells = [], 0
    if out:
        yield from pa.Table.from_pylist(out, _ARROW).to_batches()


def execute_sqlite(queries: DataFrame, path_of: Callable[[str], str], timeout: float = TIMEOUT_S, most_rows: int | None = None) -> DataFrame:
    """Runs each distinct (db_id, sql) once, on the executors (X1-X4). path_of must name files they can reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _outcomes(*(batch.column(c).to_pylist() for c in ("db_id", "sql")), lambda db, sql: run_sqlite(path_of(db), sql, timeout, most_rows))

    return queries.select("db_id", "sql").distinct().mapInArrow(run, RESULT)


def execute_built(queries: DataFrame, databases: DataFrame, timeout: float = TIMEOUT_S, most_rows: int | None = None) -> DataFrame:
    """Runs each distinct (db_id, sql) once, on databases that the executors build in memory (X1-X4).

    databases: db_id, script (DDL and INSERT statements), one small database a row. Statements are spread by hash, so a
    database that most of them ask is built in every task; within a task they are sorted, so each is built once there.
    A statement without a database, or with a script that fails, is not ok.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        db: sqlite3.Connection | None = None
        fault: str | None = None
        for batch in batches:
            scripts = dict(zip(batch.column("db_id").to_pylist(), batch.column("script").to_pylist(), strict=True))

            def ask(name: str, sql: str) -> tuple[bool, list[list[str]] | None, str | None]:
                nonlocal now, db, fault
                if db is None or name != now:
                    if db is not None:
                        db.close()
                    now, fault, db = name, None, sqlite3.connect(":memory:")
                    try:
                        if scripts[name] is None:
                            raise sqlite3.Error("unknown database")
                        db.executescript(scripts[name])
                    except sqlite3.Error as e:
                        fault = str(e)
                return (False, None, fault) if fault else run_on(db, sql, timeout, most_rows)

            yield from _outcomes(batch.column("db_id").to_pylist(), batch.column("sql").to_pylist(), ask)

    asked = queries.select("db_id", "sql").distinct().join(databases.select("db_id", "script"), "db_id", "left")
    return asked.sortWithinPartitions("db_id").mapInArrow(run, RESULT)


# The reasons for which a statement is refused.
REASONS = ("sql_not_read_only", "database_missing", "sql_execution_timeout", "sql_execution_error", "spider_parse_error")


def check_statements(df: DataFrame, key: str, sql: str, ddl: str, timeout: float = TIMEOUT_S) -> DataFrame:
    """(key, reason, hardness): whether a statement runs on an empty database of its DDL and the grammar takes it (X2).

    A database is built in memory once a process and DDL text, and a statement only fetches one row.
    """
    from tamis.functions.sqlparse import catalog_of, classify

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[sqlite3.Connection | None, dict]] = {}

        def check(statement: str | None, schema: str | None) -> tuple[str | None, str | None]:
            if not re.match(r"(?i)\s*(select|with)\b", statement or ""):
                return REASONS[0], None
            if schema not in known:
                if len(known) > 1000:
                    for db, _ in known.values():
                        if db:
                            db.close()
                    known.clear()
                db = None
                if schema and schema.strip():
                    db = sqlite3.connect(":memory:")
                    try:
                        db.executescript(schema)
                        db.execute("PRAGMA query_only = ON")
                    except sqlite3.Error:
                        db = None
                known[schema] = db, catalog_of(schema)
            db, catalog = known[schema]
            if db is None:
                return REASONS[1], None
            until = time.monotonic() + timeout
            db.set_progress_handler(lambda: time.monotonic() > until, 10_000)
            try:
                db.execute(statement).fetchmany(1)
            except (sqlite3.Error, sqlite3.Warning) as e:
                return REASONS[2 if "interrupt" in str(e).lower() else 3], None
            level, fault = classify(statement, catalog)
            return (REASONS[4], None) if fault else (None, level)

        for batch in batches:
            got = [check(s, d) for s, d in zip(batch.column(sql).to_pylist(), batch.column(ddl).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [key, "reason", "hardness"])

    return df.select(key, sql, ddl).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, reason string, hardness string")


def _tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        cells = [[cell(c[i]) for c in columns] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.string()))], ["m", "cells"])


def _kept(df: DataFrame) -> str:
    """The path of a result written whole as (pos, cells), in its order."""
    spark = df.sparkSession
    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    rows = materialize(named.select(F.monotonically_increasing_id().alias("m"), "*").mapInArrow(_tagged, "m bigint, cells array<string>"), "rows")
    counts = sorted(rows.groupBy(F.shiftrightunsigned("m", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    placed = rows.withColumn("part", F.shiftrightunsigned("m", 33)).join(F.broadcast(spark.createDataFrame(starts, "part bigint, start bigint")), "part")
    return materialize(placed.select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("pos"), "cells"), "result").inputFiles()[0].rpartition("/")[0]


def compare_kept(spark: SparkSession, a: str, b: str, ordered: bool) -> tuple[bool, bool, bool]:
    """Strict, bag and permuted equality of two results kept whole; b is the gold one."""
    x, y = (spark.read.schema("pos bigint, cells array<string>").parquet(p) for p in (a, b))
    if x.count() != y.count():
        return False, False, False

    def same(left: DataFrame, places: bool) -> bool:
        columns = ["pos", "cells"] if places else ["cells"]
        return left.select(columns).exceptAll(y.select(columns)).isEmpty()  # as many rows, so one direction is enough

    strict = x.select("pos", unified(F.array("cells"))[0].alias("cells")).exceptAll(y.select("pos", unified(F.array("cells"))[0].alias("cells"))).isEmpty()
    bag = same(x, ordered)
    width = len(y.first()["cells"])
    if bag or width > MOST_COLUMNS or len(x.first()["cells"]) != width:
        return strict, strict or bag, bag and width <= MOST_COLUMNS
    # a column can only stand for one with the same values
    values = lambda d: d.agg(*(F.sum(F.xxhash64(F.col("cells")[i]).cast("decimal(38,0)")).alias(f"c{i}") for i in range(width))).first()
    have, want = values(x), values(y)
    orders = (o for o in permutations(range(width)) if all(have[o[i]] == want[i] for i in range(width)))
    permuted = any(same(x.select("pos", F.array(*(F.col("cells")[i] for i in o)).alias("cells")), ordered) for o in orders)
    return strict, strict or bag, permuted


def execute_spark(spark: SparkSession, statements: list[tuple[str, str]], timeout: float = 60.0, most_rows: int = 10_000) -> DataFrame:
    """Runs a bounded list of (db_id, sql) over the session's views, each in a job group that a timer cancels.

    For statements over large tables; for many small databases use execute_sqlite(). A result of more than most_rows rows
    is kept whole in the shared folder: `rows` is null then and `kept` names its place, and score() compares it there.
    """
    sc = spark.sparkContext
    out = []
    for n, (db, sql) in enumerate(statements):
        group = f"tamis-execute-{id(out)}-{n}"
        began = time.monotonic()
        if not read_only(sql):
            out.append((db, sql, False, None, "not read-only", 0.0, None))
            continue
        fired = threading.Event()
        timer = threading.Timer(timeout, lambda g=group, f=fired: (f.set(), sc.cancelJobGroup(g)))
        timer.start()
        try:
            sc.setJobGroup(group, "tamis execution", True)
            df = spark.sql(sql.rstrip("; "))
            first = df.limit(most_rows + 1).collect()
            kept = _kept(df) if len(first) > most_rows else None
            rows = None if kept else [[cell(x) for x in r] for r in first]
            out.append((db, sql, True, rows, None, (time.monotonic() - began) * 1000, kept))
        except Exception as e:
            syntax = "PARSE_SYNTAX_ERROR" in str(e)
            message = f"timeout after {timeout:g} s" if fired.is_set() else ("syntax error: " if syntax else "") + re.sub(r"\s+", " ", str(e))[:300]
            out.append((db, sql, False, None, message, (time.monotonic() - began) * 1000, None))
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
    return spark.createDataFrame(out, f"{RESULT}, kept string")


def score(predictions: DataFrame, gold: DataFrame, results: DataFrame, strict_gold: bool = False) -> DataFrame:
    """One row an example: exact, strict, bag and syntax flags (X8, X9). predictions: id, db_id, sql; gold: id, sql.

    With strict_gold a gold statement that fails raises (X10).
    """
    from tamis.functions.sqltext import has_order_by, is_syntax_error, normalize_sql
    from tamis.operators.compare import bags_equal, columns_permuted, strictly_equal

    r = results.select("db_id", "sql", "ok", "rows", "error", F.col("kept") if "kept" in results.columns else F.lit(None).cast("string").alias("kept"))
    joined = predictions.join(gold.select("id", F.col("sql").alias("gold_sql")), "id")
    joined = joined.join(r, ["db_id", "sql"], "left").join(r.select("db_id", F.col("sql").alias("gold_sql"), F.col("ok").alias("gold_ok"), F.col("rows").alias("gold_rows"), F.col("kept").alias("gold_kept")), ["db_id", "gold_sql"], "left")
    ordered = has_order_by(F.col("gold_sql"))
    ran = F.coalesce("ok", F.lit(False)) & F.coalesce("gold_ok", F.lit(False))
    strict = ran & strictly_equal(F.col("rows"), F.col("gold_rows"))
    bag = strict | (ran & bags_equal(F.col("rows"), F.col("gold_rows"), ordered))
    permuted = ran & columns_permuted("rows", "gold_rows", ordered)
    if "kept" in results.columns:  # a bounded list of statements; a kept result never equals a smaller one
        spark = predictions.sparkSession
        pairs = joined.where("kept IS NOT NULL AND gold_kept IS NOT NULL").select("kept", "gold_kept", ordered.alias("ordered")).distinct().collect()
        verdicts = [(p["kept"], p["gold_kept"], *compare_kept(spark, p["kept"], p["gold_kept"], p["ordered"])) for p in pairs]
        told = spark.createDataFrame(verdicts, "kept string, gold_kept string, k_strict boolean, k_bag boolean, k_permuted boolean")
        joined = joined.join(F.broadcast(told), ["kept", "gold_kept"], "left")
        both = F.col("kept").isNotNull() & F.col("gold_kept").isNotNull()
        strict, bag, permuted = (F.when(both, F.col(k)).otherwise(small) for k, small in (("k_strict", strict), ("k_bag", bag), ("k_permuted", permuted)))
    if strict_gold and (bad := joined.where(~F.coalesce("gold_ok", F.lit(False))).select("id").take(3)):
        raise ValueError(f"gold statements fail: {bad}")
    d = joined.select(
        "id", "db_id", F.coalesce("gold_ok", F.lit(False)).alias("gold_ok"), (F.lower(normalize_sql(F.col("sql"))) == F.lower(normalize_sql(F.col("gold_sql")))).alias("exact_match"),
        F.coalesce("ok", F.lit(False)).alias("executed"), (~is_syntax_error(F.col("error"))).alias("syntax_valid"), "error",
        strict.alias("strict"), bag.alias("bag"), permuted.alias("_permuted"),
    )
    return d.withColumn("permuted", F.col("bag") | F.col("_permuted")).drop("_permuted")
