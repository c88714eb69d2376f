import pytest
from pyspark.sql import functions as F

from tamis.operators import records as R


def test_acceptance_rule(spark):
    rows = [("pass", "pass", False, None), ("fail", "pass", False, "judge_fail"), ("uncertain", "fail", True, None), (None, "pass", False, None), (None, "fail", False, "deterministic_fail"), ("pass", "fail", False, None), (None, None, False, "deterministic_fail")]
    df = spark.createDataFrame(rows, "v string, c string, x boolean, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", R.acceptance(F.col("v"), F.col("c"), F.col("x"))).collect())


def test_contracts(spark):
    df = spark.createDataFrame([("q", "s", "SELECT 1"), (" ", "s", None)], "question string, schema string, sql string")
    m = R.chat_record("sys", F.col("question"), F.col("schema"), F.col("sql"))
    assert [r["v"] for r in df.select(R.contract_violations(m).alias("v")).collect()] == [[], ["blank"]]
    assert [r["v"] for r in df.select(R.missing_fields(["question", "sql"]).alias("v")).collect()] == [[], ["question", "sql"]]
    with pytest.raises(R.ContractError):
        R.require(df, F.col("sql").isNotNull(), "sql")
    shots = R.with_demonstrations(m, [("u", "a")])
    assert [x["content"] for x in df.select(shots.alias("m")).first()["m"]][1:3] == ["u", "a"]


def test_question_issues(spark):
    df = spark.createDataFrame([("3 of 5 %", "3 sur 5 %"), ("3", "4"), ("a", "SELECT x"), ("1", "1"), (None, None)], "s string, q string")
    got = [r["i"] for r in df.select(R.question_issues(F.col("s"), F.col("q")).alias("i")).collect()]
    assert got == [[], ["numbers", "no_letter"], ["holds_sql"], ["no_letter"], []]


def test_upsert_and_differences(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, q string")
    over = spark.createDataFrame([(2, "B"), (3, "C")], "id int, q string")
    assert sorted(map(tuple, R.upsert(base, over, "id", ["q"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert tuple(R.id_differences(base, over, "id").first()) == (1, 1)
    with pytest.raises(R.ContractError):
        R.paired_by_id(base, over, "id")
    assert [r["q"] for r in R.last_wins(base.union(over), ["id"], "q").orderBy("id").collect()] == ["a", "b", "C"]


def test_greedy_accept(spark):
    rows = [(1, "k", True, False), (2, "k", True, True), (3, "k", True, True), (4, "k", False, True), (5, "j", True, False)]
    df = spark.createDataFrame(rows, "i int, k string, long boolean, ok boolean")
    got = R.greedy_accept(df, F.col("k"), F.col("long"), F.col("ok"), F.lit("bad"), "i")
    assert {r["i"]: r["reason"] for r in got.collect()} == {1: "bad", 2: None, 3: "duplicate", 4: "too_short", 5: "bad"}


def test_two_key_accept_by_brute_force(spark):
    rows = [(i, f"d{i % 3}", f"q{(i * 7) % 11}", f"s{(i * 5) % 13}") for i in range(200)]
    df = spark.createDataFrame(rows, "i int, db string, q string, s string")
    kept, seen = [], set()
    for i, d, q, s in rows:
        if (d, "q", q) not in seen and (d, "s", s) not in seen:
            kept.append(i)
            seen |= {(d, "q", q), (d, "s", s)}
    assert sorted(r["i"] for r in R.two_key_accept(df, "db", F.col("q"), F.col("s"), ["i"]).collect()) == kept


def test_fingerprint_union_and_rounds(spark):
    base = spark.createDataFrame([("a", "x"), ("a", "x")], "q string, s string")
    more = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "y")], "i int, q string, s string")
    got = sorted(map(tuple, R.fingerprint_union(base, more, ["q", "s"], "i").collect()))
    assert got == [("a", "x", "base"), ("a", "x", "base"), ("b", "y", "added")]
    r1 = spark.createDataFrame([("1", "old", "pass"), ("2", "two", "fail")], "id string, q string, verdict string")
    r2 = spark.createDataFrame([("1", "new", "pass")], "id string, q string, verdict string")
    assert [tuple(r) for r in R.merged_rounds([r1, r2], "id", "q").collect()] == [("1", "new", 1)]
