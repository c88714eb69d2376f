"""Writers: JSON lines, manifests, logs, chunked files, SQLite databases and file fingerprints (SNK1-SNK8)."""

from __future__ import annotations

import re
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PolicyError(ValueError):
    """A database breaks what generated databases must keep to."""


def write_jsonl(df: DataFrame, path: str, files: int | None = None, overwrite: bool = True) -> None:
    """Null fields are left out. Without overwrite an existing folder raises (SNK4)."""
    (df.coalesce(files) if files else df).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(df: DataFrame) -> str:
    """The pretty JSON of a one-row table (SNK2)."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("j")).first()["j"]


def write_chunked(df: DataFrame, path: str) -> None:
    """One folder a value of column chunk (SNK5)."""
    df.write.mode("overwrite").partitionBy("chunk").json(path)


def report(df: DataFrame, rows: int = 50) -> str:
    """A bounded table as Markdown (SNK7)."""
    got = df.limit(rows).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in got)])


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha256) of the files of a folder (SNK8)."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"))


# What a statement that creates or fills a table does inside SQLite, its own catalogue included.
_ALLOWED = frozenset(getattr(sqlite3, n) for n in ("SQLITE_CREATE_TABLE", "SQLITE_CREATE_INDEX", "SQLITE_INSERT", "SQLITE_READ", "SQLITE_SELECT", "SQLITE_TRANSACTION", "SQLITE_REINDEX"))


def _authorize(action: int, first: str | None, *_: str | None) -> int:
    """Only creation and insertion; changes only to SQLite's own catalogue, no functions, attached files or pragmas (U3)."""
    own = action == sqlite3.SQLITE_UPDATE and first == "sqlite_master"
    return sqlite3.SQLITE_OK if own or action in _ALLOWED else sqlite3.SQLITE_DENY


def build_sqlite(path: str, ddl: list[str], inserts: list[str], tables: tuple[int, int] = (4, 8), least_rows: int = 10) -> None:
    """A database of CREATE TABLE and INSERT statements only, checked for keys, table count and rows (SNK6).

    A statement that does anything else is refused, by its first words and by SQLite's authorizer.
    """
    for statements, prefix in ((ddl, "create table"), (inserts, "insert into")):
        for s in statements:
            if not s.strip().lower().startswith(prefix) or re.search(r"(?i)\b(attach|pragma|drop|delete|update|alter|trigger)\b", s.split("(")[0]):
                raise PolicyError(f"not allowed: {s[:80]}")
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    db = sqlite3.connect(path)
    try:
        db.execute("PRAGMA foreign_keys = OFF")
        db.set_authorizer(_authorize)
        for s in [*ddl, *inserts]:
            db.execute(s)
        db.set_authorizer(None)
        if broken := db.execute("PRAGMA foreign_key_check").fetchall():
            raise PolicyError(f"rows without parent: {broken[:3]}")
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        if not tables[0] <= len(names) <= tables[1]:
            raise PolicyError(f"{len(names)} tables")
        for n in names:
            if (count := db.execute(f'SELECT count(*) FROM "{n}"').fetchone()[0]) < least_rows:
                raise PolicyError(f"{n} has {count} rows")
        db.commit()
    except BaseException:
        db.close()
        target.unlink(missing_ok=True)
        raise
    db.close()
