import json

import pytest
from pyspark.sql import functions as F

from tamis.operators import nested
from tamis.operators.nested import NestedRecords, infer_schema


def _lines(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "k bigint, raw string")


def test_tables_keep_parent_links(spark):
    rec = {"id": "a", "n": 1, "items": [{"x": 1, "tags": ["p", "q"]}, {"x": 2.5}], "one": {"deep": {"v": True}}}
    t = NestedRecords(_lines(spark, json.dumps(rec), json.dumps({"id": "b", "items": None})), "raw", "k").tables()
    assert set(t) == {"", "items", "items.tags"}
    root = {r["_key"]: r for r in t[""].collect()}
    assert root[0]["id"] == "a" and root[0]["n"] == 1 and root[0]["one_deep_v"] is True and root[1]["n"] is None
    items = sorted(t["items"].collect(), key=lambda r: r["_ordinal"])
    assert [r["x"] for r in items] == [1.0, 2.5] and {r["_parent"] for r in items} == {root[0]["_id"]}
    tags = sorted(t["items.tags"].collect(), key=lambda r: r["_ordinal"])
    assert [r["value"] for r in tags] == ["p", "q"] and {r["_parent"] for r in tags} == {items[0]["_id"]}


def test_shapes_that_vary(spark):
    lines = [
        json.dumps({"c": [{"t": 1}, {"t": 2}]}), json.dumps({"c": {"t": 3}}), json.dumps({"c": "plain"}), json.dumps({"c": None}), json.dumps({}),
        json.dumps({"b": {"s": "x"}}), json.dumps({"b": json.dumps({"s": "y"})}), json.dumps({"b": "no json"}),
    ]
    n = NestedRecords(_lines(spark, *lines), "raw", "k")
    t = n.tables()
    got = sorted((r["_key"], r["_ordinal"], r["t"], r["value"]) for r in t["c"].collect())
    assert got == [(0, 0, 1, None), (0, 1, 2, None), (1, 0, 3, None), (2, 0, None, "plain")]
    assert {r["_key"]: (r["b"], r["b_s"]) for r in t[""].collect() if r["_key"] > 4} == {5: (None, "x"), 6: (None, "y"), 7: ("no json", None)}
    outer = n.explode(n.root, n.schema, ("c",), outer=True).groupBy("_key").count().collect()
    assert {r["_key"]: r["count"] for r in outer}[3] == 1


def test_invalid_lines_give_no_row(spark):
    bad = ['{"a": 1', '{"a": 1} x', '{"a": 1}, {"a": 2}', "", None, "[1", "1] x [2"]
    good = ['{"a": 1}', " [1, 2] ", "3"]
    assert {r["_key"] for r in NestedRecords(_lines(spark, *bad, *good), "raw", "k").root.collect()} == {7, 8, 9}


def test_clashing_and_odd_names(spark):
    n = NestedRecords(_lines(spark, json.dumps({"_key": 1, "a": {"b": 1}, "a_b": 2, "A_B": 3, "it's": 4, 'd"q': 5})), "raw", "k")
    row = n.tables()[""].first().asDict()
    assert sorted(v for k, v in row.items() if k not in ("_key", "_id")) == [1, 1, 2, 3, 4, 5]


def test_empty_table_and_long_text(spark):
    assert NestedRecords(_lines(spark).limit(0), "raw", "k").tables()[""].count() == 0
    long = json.dumps({"t": "é" * 300_000, "l": list(range(2000))})
    t = NestedRecords(_lines(spark, long, long), "raw", "k").tables()
    assert t["l"].count() == 4000 and len(t[""].first()["t"]) == 300_000


def test_named_fields_get_past_keys_that_are_data(spark):
    lines = [json.dumps({f"id{i}": {"x": 1}, "a": {f"k{i}": 0, "b": [{"c": i}, {"c": str(i)}]}, "t": {"u": i, "v": 1} if i % 2 else json.dumps({"u": i})}) for i in range(300)]
    df = _lines(spark, *lines)
    fields = [("a", "b"), ("t", "u"), ("a", "b", "c"), ("none", "here")]
    few = infer_schema(df, "raw", fields, most=20)
    every = infer_schema(df, "raw")
    assert set(few.children) == {"a", "t"} and set(few.children["a"].children) == {"b"} and len(every.children) == 302
    assert few.children["a"].children["b"].element.children["c"].kinds == every.children["a"].children["b"].element.children["c"].kinds
    with pytest.raises(ValueError, match="fields"):
        infer_schema(df, "raw", most=20)
    n = NestedRecords(df, "raw", "k", fields)
    rows = n.explode(n.root, n.schema, ("a", "b")).select("_key", "_ordinal", n.value(F.col("_v"), n.node(("a", "b")).element, ("c",)).alias("c")).collect()
    assert len(rows) == 600 and {r["c"] for r in rows} == {str(i) for i in range(300)}
    assert n.root.select(n.value(F.col("_v"), n.schema, ("t", "u")).alias("u")).distinct().count() == 300


def test_an_inventory_in_parts_is_the_same(spark, monkeypatch):
    lines = [json.dumps({f"k{i % 40}": {"x": i, "y": [i, None]}}) for i in range(200)]
    whole = infer_schema(_lines(spark, *lines), "raw")
    monkeypatch.setattr(nested, "FLUSH", 3)
    assert infer_schema(_lines(spark, *lines), "raw") == whole
