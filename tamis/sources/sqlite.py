"""SQLite files as a Spark data source, and scans of their catalogs (SRC6-SRC10).

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", file).option("dbtable", "t").load()

Rows are split into ranges of rowid, one partition each, so large tables are read in parallel.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = (("INT", T.LongType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BLOB", T.BinaryType()))


def connect(path: str) -> sqlite3.Connection:
    """Read-only; bytes that aren't UTF-8 are replaced."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[RowRange]:
        db = connect(self.options["path"])
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['dbtable'])}").fetchone()
        db.close()
        if low is None:
            return []
        parts = max(1, min(int(self.options.get("partitions", "4")), high - low + 1))
        step = -(-(high - low + 1) // parts)
        return [RowRange(i, min(high, i + step - 1)) for i in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        db = connect(self.options["path"])
        columns = ", ".join(map(_quoted, self.schema.names))
        kinds = [f.dataType for f in self.schema.fields]
        cast = {T.LongType: int, T.DoubleType: float, T.StringType: str}
        for row in db.execute(f"SELECT {columns} FROM {_quoted(self.options['dbtable'])} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)):
            out = []
            for x, kind in zip(row, kinds, strict=True):
                try:
                    out.append(x if x is None or isinstance(kind, T.BinaryType) else cast[type(kind)](x))
                except ValueError:  # SQLite's types are advice: a text in a number column is no number
                    out.append(None)
            yield tuple(out)
        db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        db = connect(self.options["path"])
        rows = db.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        db.close()
        kind = lambda declared: next((t for mark, t in _KINDS if mark in (declared or "").upper()), T.StringType())
        return T.StructType([T.StructField(r[1], kind(r[2])) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def table_names(path: str) -> list[str]:
    db = connect(path)
    names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    db.close()
    return names


def sample_text(path: str, rows: int = 3, width: int = 40) -> str:
    """The first rows of each table, values cut to a width, for prompts (SRC6)."""
    db = connect(path)
    out = []
    for t in table_names(path):
        cursor = db.execute(f"SELECT * FROM {_quoted(t)} LIMIT {int(rows)}")
        out.append(f"{t}: " + " | ".join(d[0] for d in cursor.description))
        out += [" | ".join(str(x)[:width] for x in r) for r in cursor]
    db.close()
    return "\n".join(out)


def inspect(paths: DataFrame) -> DataFrame:
    """(db_id, ok, ddl, table_name, columns, is_empty) of each table of many files (SRC7-SRC10); paths: db_id, path.

    A missing or damaged file gives one row with ok false.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for db_id, path in zip(batch.column("db_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    db = connect(path)
                    ok = db.execute("PRAGMA integrity_check").fetchone()[0] == "ok"
                    ddl = ";\n\n".join(r[0] for r in db.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND sql IS NOT NULL AND name NOT LIKE 'sqlite_%' ORDER BY name"))
                    for t in table_names(path):
                        columns = [r[1].lower() for r in db.execute(f"PRAGMA table_info({_quoted(t)})")]
                        empty = db.execute(f"SELECT 1 FROM {_quoted(t)} LIMIT 1").fetchone() is None
                        out.append((db_id, ok, ddl, t.lower(), columns, empty))
                    db.close()
                except sqlite3.Error:
                    out.append((db_id, False, None, None, None, None))
            names = ["db_id", "ok", "ddl", "table_name", "columns", "is_empty"]
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return paths.select("db_id", "path").mapInArrow(run, "db_id string, ok boolean, ddl string, table_name string, columns array<string>, is_empty boolean")
