"""Readers of JSON lines and JSON documents (SRC1-SRC5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """One record a line, blank lines skipped; broken lines are dropped, or raise if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole document that is a list of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_with_ordinal(spark: SparkSession, path: str, schema: str, split: str) -> DataFrame:
    """Records with id '<split>:<n>', n counting the lines of the file that aren't blank.

    The file is read as one value, since line numbers need it whole: for files that fit a task.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("n", "line"))
    return rows.select(F.concat(F.lit(f"{split}:"), F.col("n").cast("string")).alias("id"), F.from_json("line", schema).alias("r")).select("id", "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An input that may be missing: then an empty table. Required inputs use read_jsonl, which raises."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_many(spark: SparkSession, paths: list[str], schema: str, pattern: str | None = None) -> DataFrame:
    """Several files or folders as one table, each row with its file's name."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(paths).select("*", F.col("_metadata.file_name").alias("file_name"))
