"""Queries of the nested-records problem over batch_responses.raw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.nested import Node, NestedRecords
from tamis.session import table


# What p1_found reads; keys elsewhere may be as many as they like.
_FIELDS = [("custom_id",), ("response", "body", "status"), ("response", "body", "incomplete_details"), ("response", "body", "output"), ("response", "body", "choices")]


def _records(spark: SparkSession, sf_dir: str, fields: list[tuple[str, ...]] | None = None) -> NestedRecords:
    return NestedRecords(table(spark, sf_dir, "batch_responses"), "raw", "line_id", fields)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per content block; items without blocks and responses without items give -1."""
    n = _records(spark, sf_dir, _FIELDS)
    text = lambda *path: F.coalesce(n.value(F.col("_v"), n.schema, path, "string"), F.lit(""))
    details = ("response", "body", "incomplete_details")
    told = n.value(F.col("_v"), n.schema, (*details, "reason"), "string")
    plain = n.value(F.col("_v"), n.schema, details) if n.node(details) is not None else F.lit(None).cast("string")
    root = n.root.select("*", text("custom_id").alias("custom_id"), text("response", "body", "status").alias("status"), F.coalesce(told, plain, F.lit("")).alias("incomplete_reason"))
    items = n.explode(root, n.schema, ("response", "body", "output"), ("response", "body", "choices"), outer=True, ordinal="output_no")
    item = Node()
    for path in (("response", "body", "output"), ("response", "body", "choices")):
        if (found := n.node(path)) is not None and found.element is not None:
            item.merge(found.element)
    blocks = n.explode(items, item, ("content",), ("message", "content"), outer=True, ordinal="content_no")
    return blocks.select(F.col("_key").alias("line_id"), "custom_id", "status", "incomplete_reason", "output_no", "content_no")


def _flat(name: str, columns: tuple[str, ...] = ()):
    """A flat table; with columns these only, null where no record has them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = _records(spark, sf_dir)
        tables = n.tables()
        found = tables[name] if name in tables else n.root.select("_key", "_id", F.lit("").alias("_parent"), F.lit(0).cast("bigint").alias("_ordinal")).limit(0)
        if not columns:
            return found
        return found.select("_key", "_id", "_parent", "_ordinal", *((F.col(c) if c in found.columns else F.lit(None)).cast("string").alias(c) for c in columns))

    query.__doc__ = f"The flat table {name or 'of the responses'}."
    return query


QUERIES = {
    "p1_found": p1_found,
    "p1_responses": _flat(""),
    "p1_output_items": _flat("response.body.output", ("id", "role", "status", "type")),
    "p1_content_blocks": _flat("response.body.output.content", ("value", "text", "type")),
    "p1_choices": _flat("response.body.choices", ("finish_reason", "index", "message_role")),
    "p1_choice_blocks": _flat("response.body.choices.message.content", ("value", "text", "type")),
}

_BODY = """WITH j AS (SELECT line_id, raw::JSON AS r FROM batch_responses WHERE json_valid(raw)),
b AS (SELECT line_id, coalesce(r->>'$.custom_id', '') AS custom_id,
  CASE WHEN json_type(r->'$.response.body') = 'VARCHAR' AND json_valid(r->>'$.response.body') THEN (r->>'$.response.body')::JSON ELSE r->'$.response.body' END AS body FROM j),
"""

ORACLE = {
    "p1_found": _BODY
    + """s AS (SELECT *, coalesce(body->>'$.status', '') AS status,
  coalesce(CASE json_type(body->'$.incomplete_details') WHEN 'OBJECT' THEN body->>'$.incomplete_details.reason' WHEN 'VARCHAR' THEN CASE WHEN json_valid(body->>'$.incomplete_details') THEN (body->>'$.incomplete_details')::JSON->>'$.reason' ELSE body->>'$.incomplete_details' END END, '') AS incomplete_reason,
  CASE WHEN json_type(body->'$.output') = 'ARRAY' THEN (body->'$.output')::JSON[] WHEN json_type(body->'$.output') = 'OBJECT' THEN [body->'$.output']
       WHEN json_type(body->'$.choices') = 'ARRAY' THEN (body->'$.choices')::JSON[] WHEN json_type(body->'$.choices') = 'OBJECT' THEN [body->'$.choices'] ELSE []::JSON[] END AS items FROM b),
i AS (SELECT line_id, custom_id, status, incomplete_reason, unnest(CASE WHEN len(items) = 0 THEN [-1] ELSE range(len(items))::BIGINT[] END) AS output_no, items FROM s),
c AS (SELECT * EXCLUDE (items), CASE WHEN output_no < 0 THEN NULL ELSE coalesce(items[output_no + 1]->'$.content', items[output_no + 1]->'$.message.content') END AS content FROM i),
d AS (SELECT * EXCLUDE (content), CASE WHEN content IS NULL OR json_type(content) = 'NULL' THEN 0 WHEN json_type(content) = 'ARRAY' THEN json_array_length(content) ELSE 1 END AS n FROM c)
SELECT line_id, custom_id, status, incomplete_reason, output_no::BIGINT AS output_no, unnest(CASE WHEN n = 0 THEN [-1] ELSE range(n::BIGINT)::BIGINT[] END)::BIGINT AS content_no FROM d""",
}


def _children(at: str, below: str = "") -> str:
    """The rows of a list of the body, or of a list below each of its elements, a lone value counting as a list of one."""
    listed = lambda x: f"CASE WHEN ({x}) IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({x}) = 'ARRAY' THEN ({x})::JSON[] ELSE [({x})] END"
    rows = f"i AS (SELECT _key, _key || '/response/body/{at}:' || (o - 1) AS _id, _key::VARCHAR AS _parent, (o - 1)::BIGINT AS _ordinal, l[o] AS v FROM (SELECT _key, l, unnest(range(1, len(l) + 1)) AS o FROM (SELECT line_id AS _key, {listed(f'body->{chr(39)}$.{at}{chr(39)}')} AS l FROM b)))"
    if not below:
        return _BODY + rows
    inner = listed(f"v->'$.{below}'")
    return _BODY + rows + f", c AS (SELECT _key, _id || '/{below.replace('.', '/')}:' || (o - 1) AS _id, _id AS _parent, (o - 1)::BIGINT AS _ordinal, l[o] AS v FROM (SELECT _key, _id, l, unnest(range(1, len(l) + 1)) AS o FROM (SELECT _key, _id, {inner} AS l FROM i)))"


_KEYS = " SELECT _key, _id, _parent, _ordinal, "
_BLOCK = "CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' END AS value, v->>'$.text' AS text, v->>'$.type' AS type FROM c"
ORACLE |= {
    "p1_output_items": _children("output") + _KEYS + "v->>'$.id' AS id, v->>'$.role' AS role, v->>'$.status' AS status, v->>'$.type' AS type FROM i",
    "p1_content_blocks": _children("output", "content") + _KEYS + _BLOCK,
    "p1_choices": _children("choices") + _KEYS + "v->>'$.finish_reason' AS finish_reason, v->>'$.index' AS \"index\", v->>'$.message.role' AS message_role FROM i",
    "p1_choice_blocks": _children("choices", "message.content") + _KEYS + _BLOCK,
}
