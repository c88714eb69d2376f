import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import diverse
from tamis.llm.diverse import Candidates, disperse, features, members, varied_subset


def _of(rng, n, structures=3):
    return Candidates([f"s{rng.integers(structures)}" if rng.random() > 0.1 else "" for _ in range(n)], [f"h{rng.integers(2)}" if rng.random() > 0.1 else "" for _ in range(n)], [" ".join(f"name{x}" for x in rng.integers(0, 60, 8)) for _ in range(n)])


def test_local_optimum():
    of = _of(np.random.default_rng(2), 40)
    d = of.distances(np.arange(40))
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0) and d.max() <= 3
    total = lambda s: d[np.ix_(s, s)].sum() / 2
    chosen = disperse(of, 5, 0)
    have = total(chosen)
    for out, new in itertools.product(chosen, set(range(40)) - set(chosen.tolist())):
        assert total([x for x in chosen if x != out] + [new]) <= have + 1e-4
    few = of.take(np.arange(14))
    best = max(total(list(s)) for s in itertools.combinations(range(14), 3))
    assert total(disperse(few, 3, 0)) >= 0.9 * best


def test_missing_labels_add_nothing():
    d = Candidates(["a", "b", "", "a"], ["x", "x", "x", ""], ["SELECT 1"] * 4).distances(np.arange(4))
    assert d[0].tolist() == [0, 2, 0, 0] and d[1].tolist() == [2, 0, 0, 1]


def _frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, e array<struct<structure:string,hardness:string,sql:string>>")


def test_frequent_kinds_do_not_fill(spark, monkeypatch):
    monkeypatch.setattr(diverse, "BATCH", 64)
    rng = random.Random(3)
    common = ("single", "easy", "SELECT a FROM t")
    often = [("single", "easy", f"SELECT c{i} FROM t{i}") for i in range(200)]
    rare = [(f"kind{i % 9}", rng.choice(["easy", "hard"]), f"SELECT c{i} FROM t{i} JOIN u{i} ON x{i} = y{i} GROUP BY z{i}") for i in range(100)]
    df = _frame(spark, [[common] * 5, [common, None], None, []] + [[r, common] for r in rare + often])
    c = members(df, "e")
    assert c.count() == 301 and c.where(F.col("occurrences") > 100).count() == 1
    got = varied_subset(c, 20).collect()
    assert len(got) == 20 and len({r["sql"] for r in got}) == 20
    assert len({r["structure"] for r in got}) == 10 and sum(r["structure"] == "single" for r in got) <= 3
    assert {r["key"] for r in varied_subset(c.repartition(9), 20).collect()} == {r["key"] for r in got}
    # more wanted than one search takes: the groups choose their parts
    many = varied_subset(c, 250, most=60).collect()
    assert len(many) == 250 == len({r["key"] for r in many})
    assert varied_subset(c, 300, most=7).count() == 300


def test_labels_and_spellings_of_a_statement(spark):
    df = _frame(spark, [[("SINGLE", None, "SELECT 1"), ("single", " Easy", "select  1;"), ("", "easy", "SELECT 1"), ("other", "hard", "SELECT 1"), ("single", "easy.", "SELECT 1")], [("x", "y", ""), ("x", "y", None), ("x", "y", " ;")]])
    got = members(df, "e").collect()
    assert [(r["structure"], r["hardness_key"], r["occurrences"]) for r in got] == [("single", "easy", 5)]


def test_few_nulls_and_nothing(spark):
    df = _frame(spark, [[(None, None, None), ("s", "h", "SELECT 1"), ("S.", "h", "select  1"), (None, None, "SELECT a FROM b")]])
    assert varied_subset(members(df, "e"), 10).count() == 2
    assert varied_subset(members(df.limit(0), "e"), 10).count() == 0
    assert len(features(None)) == 0 and len(features("SELECT x " * 5000)) and features("SELECT a FROM t WHERE b = 1").tolist() == features("select A from t where b = 22").tolist()
    clash = df.withColumns({"key": F.lit(1), "sql": F.lit("x"), "occurrences": F.lit(2), "m": F.lit(3)})
    assert members(clash, "e").count() == 2
