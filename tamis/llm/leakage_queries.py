"""Queries of the leakage problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.leakage import leaked_passages
from tamis.session import table


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", ["question", "sql"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim match of each document and item's field, with its place in both."""
    return _passages(spark, sf_dir).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without any held-out passage."""
    return table(spark, sf_dir, "documents").select("doc_id").join(p8_found(spark, sf_dir), "doc_id", "left_anti")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item that leaked, in how many documents and the longest passage."""
    return p8_passages(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


QUERIES = {"p8_found": p8_found, "p8_passages": p8_passages, "p8_clean_documents": p8_clean_documents, "p8_leaked_items": p8_leaked_items}

_PAIRS = """WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
t AS (SELECT item_id, regexp_extract_all(strip_accents(lower(question)), '[a-z0-9]+') AS w FROM heldout_items UNION ALL SELECT item_id, regexp_extract_all(strip_accents(lower(sql)), '[a-z0-9]+') FROM heldout_items),
tg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM t WHERE len(w) >= 10)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN tg USING (g))
"""
# Ten-word runs that meet, chained along their diagonal into longest matches; the first longest one of each document and field.
_LONGEST = """WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS w FROM documents),
dg AS (SELECT doc_id, i, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
t AS (SELECT item_id, 'question' AS field, regexp_extract_all(strip_accents(lower(question)), '[a-z0-9]+') AS w FROM heldout_items UNION ALL SELECT item_id, 'sql', regexp_extract_all(strip_accents(lower(sql)), '[a-z0-9]+') FROM heldout_items),
tg AS (SELECT item_id, field, j, array_to_string(w[j : j + 9], ' ') AS g FROM (SELECT item_id, field, w, unnest(range(1, len(w) - 8)) AS j FROM t WHERE len(w) >= 10)),
m AS (SELECT doc_id, item_id, field, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, field, i - j ORDER BY i) AS run FROM dg JOIN tg USING (g)),
r AS (SELECT doc_id, item_id, field, count(*) + 9 AS words, min(i) - 1 AS doc_word, min(j) - 1 AS item_word FROM m GROUP BY doc_id, item_id, field, i - j, run),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, field ORDER BY words DESC, doc_word, item_word) AS n FROM r)
"""
ORACLE = {
    "p8_found": _PAIRS + "SELECT doc_id, item_id FROM f",
    "p8_clean_documents": _PAIRS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)",
    "p8_passages": _LONGEST + "SELECT doc_id, item_id, field, words::INT AS words, doc_word, item_word FROM l WHERE n = 1",
    "p8_leaked_items": _LONGEST + "SELECT item_id, count(DISTINCT doc_id) AS documents, max(words)::INT AS longest FROM l WHERE n = 1 GROUP BY item_id",
}
