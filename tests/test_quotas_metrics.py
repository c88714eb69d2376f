import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tamis.operators import metrics as M
from tamis.operators import quotas as Q
from tamis.operators import stats as T


def test_largest_remainder(spark):
    rng = random.Random(1)
    for total in (7, 100):
        w = [(f"k{i}", rng.randrange(1, 40)) for i in range(9)]
        got = Q.largest_remainder(spark.createDataFrame(w, "k string, w int"), "k", "w", total).collect()
        s = sum(x for _, x in w)
        assert sum(r["quota"] for r in got) == total
        assert all(math.floor(total * r["w"] / s) <= r["quota"] <= math.floor(total * r["w"] / s) + 1 for r in got)
    tie = Q.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1)], "k string, w int"), "k", "w", 1).collect()
    assert {r["k"]: r["quota"] for r in tie} == {"a": 0, "b": 1}  # ties go to the greater key
    tie = Q.integer_remainder(spark.createDataFrame([("a", 1), ("b", 1)], "k string, w int"), "k", "w", 1).collect()
    assert {r["k"]: r["quota"] for r in tie} == {"a": 1, "b": 0}


def test_rotating_and_halves(spark):
    t = spark.createDataFrame([("a", 5), ("b", 6), ("c", 3)], "k string, t int")
    got = {(r["k"], r["level"]): r["quota"] for r in Q.rotating_levels(t, "k", "t", ["w", "x", "y", "z"]).collect()}
    assert [got["a", x] for x in "wxyz"] == [2, 1, 1, 1] and [got["b", x] for x in "wxyz"] == [1, 2, 2, 1] and [got["c", x] for x in "wxyz"] == [1, 1, 0, 1]
    h = {(r["k"], r["level"]): r["quota"] for r in Q.halves(t, "k", "t", ("p", "q")).collect()}
    assert [h[k, "p"] for k in "abc"] == [3, 3, 1] and sum(h.values()) == 14


def test_nested_subsets_are_nested(spark):
    rows = [(i, f"s{i % 7}") for i in range(333)]
    d = Q.nested_subsets(spark.createDataFrame(rows, "i int, s string"), ["s"], "i", [25, 50, 75, 100], 1).collect()
    assert all(r["first_percent"] for r in d)
    for p in (25, 50, 75, 100):
        assert sum(r["first_percent"] <= p for r in d) == 333 * p // 100


@pytest.mark.parametrize("target", [0, 5, 12, 99])
def test_water_filling(target):
    supply, weights = {"a": 3, "b": 10, "c": 2}, {"a": 8, "b": 1, "c": 1}
    got = Q.water_filling(supply, weights, target)
    assert sum(got.values()) == min(target, 15) and all(0 <= got[k] <= supply[k] for k in supply)


def test_mixed_chunks():
    quotas = {"easy": 13, "hard": 5, "extra": 3}
    chunks = Q.mixed_chunks(quotas, 4)
    assert all(sum(c.values()) <= 4 for c in chunks) and {k: sum(c.get(k, 0) for c in chunks) for k in quotas} == quotas


def test_percentiles_and_ranked(spark):
    values = [random.Random(2).randrange(50) for _ in range(97)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    r = df.agg(M.nearest_rank("v", 0.5).alias("p50"), M.nearest_rank("v", 0.95).alias("p95"), M.lower_rank("v", 0.95).alias("low"), F.median("v").alias("m")).first()
    s = sorted(values)
    assert (r["p50"], r["p95"], r["low"], r["m"]) == (s[math.ceil(97 * 0.5) - 1], s[math.ceil(97 * 0.95) - 1], s[int(97 * 0.95) - 1], statistics.median(values))
    placed = {x["i"]: x["position"] for x in M.ranked(df, [F.col("v"), F.col("i")]).collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda x: x[1])] == [i for _, i in sorted((v, i) for i, v in enumerate(values))]
    assert M.ranked(df.limit(0), [F.col("i")]).count() == 0


@pytest.mark.parametrize(("gained", "lost", "p"), [(142, 77, 1.33193459662e-05), (153, 77, 6.066408952e-07), (156, 92, 5.791255722e-05), (156, 93, 7.863793048e-05), (0, 0, 1.0), (5000, 5000, 1.0)])
def test_mcnemar(spark, gained, lost, p):
    got = spark.createDataFrame([(gained, lost)], "g int, l int").select(T.mcnemar(F.col("g"), F.col("l")).alias("p")).first()["p"]
    assert got == pytest.approx(p, rel=1e-6)


def test_bootstrap_is_bounded(spark):
    df = spark.createDataFrame([(f"c{i % 5}", i % 3 - 1) for i in range(60)], "c string, d int")
    r = T.cluster_bootstrap(df, "c", F.col("d"), 100, 1).first()
    assert r["low"] <= r["mean"] <= r["high"]


def test_rates_of_nothing(spark):
    empty = spark.createDataFrame([], "ok boolean, g string")
    assert empty.agg(M.rate(F.col("ok")).alias("r")).first()["r"] == 0
    total = M.by_group_with_total(spark.createDataFrame([(True, None), (None, "x")], "ok boolean, g string"), "g", {"ok": F.col("ok")})
    assert {r["g"]: (r["n"], r["ok"]) for r in total.collect()} == {"": (1, 1), "x": (1, 0), "total": (2, 1)}


def test_ranks_within_groups_of_any_size(spark):
    rows = [("a" if i % 3 else None, i * 7919 % 1009, i) for i in range(900)] + [("b", None, 1000), ("b", 4, 1001)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = {r["k"]: r["place"] for r in M.ranked_within(df, ["g"], [F.col("v"), F.col("k")]).collect()}
    for g in (None, "a", "b"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[k] for _, _, k in order] == list(range(1, len(order) + 1))
    ranks = {r["g"]: (r["p50"], r["p95"], r["p100"]) for r in M.nearest_ranks(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g in (None, "a", "b"):
        v = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        assert ranks[g] == tuple(v[max(0, math.ceil(len(v) * q) - 1)] for q in (0.5, 0.95, 1.0))
    assert M.nearest_ranks(df.limit(0), ["g"], "v", {"p50": 0.5}).count() == 0


def test_capped_by_window_and_by_range(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "IF(id % 10 = 0, 'x', IF(id % 10 = 1, 'z', 'y')) AS g")
    quota = spark.createDataFrame([("x", 40), ("y", 900), ("w", 5)], "g string, quota int")
    few = {r["id"] for r in Q.capped(df, ["g"], quota, Q.hash_order(1, "id"), "id").collect()}
    monkeypatch.setattr(Q, "FEW", 1)
    assert {r["id"] for r in Q.capped(df, ["g"], quota, Q.hash_order(1, "id"), "id").collect()} == few and len(few) == 940
    assert Q.chunks(df, 100, "id").groupBy("chunk").count().where("count = 100").count() == 30
