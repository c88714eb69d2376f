import random

import pytest
from pyspark.sql import functions as F

from tamis.llm.splits import deal_groups, grouped_records, question_links, spanning_forest, split_records


def _components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, e string, q string")


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"e{rng.randrange(60)}", f"Q {rng.randrange(90)}?") for i in range(150)]
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[2] == b[2]]
    want = _components(pairs, {r[1] for r in rows})
    first = {}
    for e, r in want.items():
        first[r] = min(first.get(r, e), e)
    got = {r["k"]: r["group_db"] for r in grouped_records(_frame(spark, rows), "e", "q").collect()}
    assert got == {k: first[want[e]] for k, e, _ in rows}


def test_forest_spans_with_strongest_edges(spark):
    edges = [("a", "b", 5), ("b", "c", 1), ("a", "c", 3), ("d", "e", 2), ("e", "f", 2), ("d", "f", 2)]
    forest, labels = spanning_forest(spark.createDataFrame(edges, "u string, v string, w bigint"))
    got = {(r["u"], r["v"]) for r in forest.collect()}
    assert {("a", "b"), ("a", "c")} <= got and len(got) == 4
    roots = {r["node"]: r["root"] for r in labels.collect()}
    assert len({roots[x] for x in "abc"}) == 1 and len({roots[x] for x in "def"}) == 1 and roots["a"] != roots["d"]


def test_chain_and_blank_questions(spark):
    n = 40
    rows = [(i, f"e{i:02d}", f"q{i}") for i in range(n)] + [(100 + i, f"e{i + 1:02d}", f"q{i}") for i in range(n - 1)]
    got = grouped_records(_frame(spark, rows), "e", "q").select("group_db").distinct().collect()
    assert [r[0] for r in got] == ["e00"]
    blank = grouped_records(_frame(spark, [(1, "a", ""), (2, "b", None), (3, "c", " ?! "), (4, "d", None)]), "e", "q")
    assert {r["k"]: r["group_db"] for r in blank.collect()} == {1: "a", 2: "b", 3: "c", 4: "d"}


def test_hot_question_gives_a_star(spark):
    rows = [(i, f"e{i % 50}", "the same") for i in range(3000)]
    assert question_links(_frame(spark, rows), "e", "q").count() == 49


def test_shares(spark):
    sizes = spark.createDataFrame([(f"g{i}", 1 + i % 4) for i in range(8000)], "group string, n bigint")
    dealt = deal_groups(sizes, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).join(sizes, "group")
    got = {r["split"]: r["n"] for r in dealt.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert sum(got.values()) == 20000 and abs(got["train"] - 16000) < 30 and abs(got["test"] - 2000) < 30
    one = deal_groups(spark.createDataFrame([("all", 10)], "group string, n bigint"), [("train", 0.8), ("test", 0.2)])
    assert [tuple(r) for r in one.collect()] == [("all", "train")]


def test_nothing_and_extra_columns(spark):
    empty = _frame(spark, []).limit(0)
    assert grouped_records(empty, "e", "q").count() == 0
    odd = _frame(spark, [(1, "a", "x"), (1, "a", "x"), (2, None, "y")]).withColumn("group", F.lit(1)).withColumn("n", F.lit(2))
    got = split_records(odd, "e", "q", [("train", 1.0)]).collect()
    assert sorted(r["group_db"] for r in got) == ["", "a", "a"]
