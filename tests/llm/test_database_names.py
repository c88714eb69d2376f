from tamis.llm.records import with_database

CATALOGUE = ["synthetic_005", "synthetic_063", "synthetic_103", "base_1", "base_01", "essai"]


def test_databases_by_value_and_by_id(spark):
    catalogue = spark.createDataFrame([(d,) for d in [*CATALOGUE, None]], "db_id string")
    rows = {
        1: ("synthetic_0103", "D:synthetic_103:easy:1", "synthetic_103"), 2: ("synthetic_63", "D:synthetic_063:easy:1", "synthetic_063"), 3: ("Synthetic5.sqlite ", "D:x:easy", "synthetic_005"),
        4: (None, "D:synthetic_005:easy", "synthetic_005"), 5: (" \t", "D:synthetic_0063:easy", "synthetic_063"), 6: ("another", "D:essai:easy", "essai"), 7: ("another_07", "D:unknown:easy", "another7"),
        8: ("BASE 1", "D:essai:x", "base_1"), 9: ("base-01", "D:essai:x", "base_01"), 10: ("base_001", None, "base_01"), 11: (None, None, ""), 12: ("essai", None, "essai"),
    }
    df = spark.createDataFrame([(k, d, i) for k, (d, i, _) in rows.items()] + [(8, "BASE 1", "D:essai:x")], "k int, db_id string, id string")
    got = [(r["k"], r["db"]) for r in with_database(df, catalogue).collect()]
    assert sorted(got) == sorted([(k, w) for k, (*_, w) in rows.items()] + [(8, "base_1")])


def test_nothing(spark):
    empty = spark.createDataFrame([], "db_id string, id string")
    assert with_database(empty, empty.select("db_id")).count() == 0
    assert [r["db"] for r in with_database(spark.createDataFrame([("a_01", "x")], "db_id string, id string"), empty.select("db_id")).collect()] == ["a1"]
