import random

from pyspark.sql import functions as F

from tamis.llm import sampling
from tamis.llm.sampling import feasible_quotas, proportional_sample, quotas, reservoirs, smallest, target_report


def test_sample_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"id{rng.randrange(400)}", rng.choice("abc"), rng.choice("xyz")) for i in range(900)] + [(1000, None, "a", "x"), (1001, "id1", None, "x")]
    targets = [(1, "a", "x", 0.2, 1), (2, "b", "y", 0.3, 1), (3, "c", "z", 0.01, 5), (4, "q", "x", 0.1, 2), (5, None, None, 0.1, 1)]
    df = spark.createDataFrame(rows, "rec bigint, who string, c1 string, c2 string")
    wanted = quotas(spark.createDataFrame(targets, "target bigint, c1 string, c2 string, target_share double, min_rows int"), 300)
    sample = reservoirs(df, wanted, ["c1", "c2"], "who", "rec")
    got = sample.collect()
    assert len({(r["target"], r["who"]) for r in got}) == len(got)
    report = {r["target"]: r for r in target_report(sample, wanted).collect()}
    for t, a, b, share, least in targets:
        have = len({w for _, w, x, y in rows if w and x == a and y == b and a})
        quota = max(least, round(share * 300))
        assert (report[t]["quota"], report[t]["drawn"], report[t]["missing"]) == (quota, min(quota, have), max(0, quota - have))
    again = reservoirs(df.repartition(7, F.rand(1)), wanted, ["c1", "c2"], "who", "rec")
    assert {(r["target"], r["who"]) for r in again.collect()} == {(r["target"], r["who"]) for r in got}


def test_smallest_by_ranges(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, rng.choice([-(1 << 63), (1 << 63) - 1, rng.randrange(-(1 << 63), 1 << 63)]), f"w{i}", n) for t, n in ((1, 40), (2, 0), (3, 5000), (4, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "target int, h bigint, who string, n int").repartition(6)
    for bits in (1, 4, 12):
        monkeypatch.setattr(sampling, "BUCKET_BITS", bits)
        got = {(r["target"], r["who"]) for r in smallest(df, "n").collect()}
        assert got == {(t, w) for k in (1, 2, 3, 4) for t, _, w, n in sorted(r for r in rows if r[0] == k)[: dict(((1, 40), (2, 0), (3, 5000), (4, 1)))[k]]}


def test_nothing_and_hot_category(spark):
    t = quotas(spark.createDataFrame([(1, "a", 1.0, 1)], "target bigint, c string, target_share double, min_rows int"), 10)
    empty = spark.createDataFrame([], "rec bigint, who string, c string")
    assert [tuple(r) for r in target_report(reservoirs(empty, t, ["c"], "who", "rec"), t).collect()] == [(1, 10, 0, 10)]
    hot = spark.range(150_000).selectExpr("id AS rec", "CAST(id AS STRING) AS who", "'a' AS c")
    assert reservoirs(hot, t, ["c"], "who", "rec").count() == 10


def test_short_targets_leave_their_places_to_others(spark):
    assert feasible_quotas({1: 0.5, 2: 0.3, 3: 0.2}, {1: 1, 2: 1, 3: 25}, {1: 10, 2: 99, 3: 99}, 90) == {1: 10, 2: 48, 3: 32}
    assert feasible_quotas({1: 0.5, 2: 0.5}, {1: 1, 2: 1}, {1: 3, 2: 4}, 90) == {1: 3, 2: 4} and feasible_quotas({1: 0.5, 2: 0.5}, {1: 8, 2: 1}, {1: 9, 2: 9}, 4) == {1: 8, 2: 1}
    # the first is nearly empty, so that the others need more than twice their quota: the pass is repeated
    rows = [(i, f"id{i}", c) for i, c in enumerate("a" * 3 + "b" * 200 + "c" * 200 + "d" * 9)]
    df = spark.createDataFrame(rows + [(1000 + i, w, c) for i, w, c in rows[:150]], "rec bigint, who string, c string")
    wanted = quotas(spark.createDataFrame([(1, "a", 0.8, 1), (2, "b", 0.1, 1), (3, "c", 0.05, 5), (4, "d", 0.0, 2), (5, "none", 0.05, 2)], "target bigint, c string, target_share double, min_rows int"), 100)
    sample, report = proportional_sample(df, wanted, ["c"], "who", "rec", 100)
    got = sample.collect()
    assert len(got) == 100 == len({r["who"] for r in got})
    assert {r["target"]: (r["quota"], r["drawn"], r["achieved_share"]) for r in report.collect()} == {1: (80, 3, 0.03), 2: (10, 63, 0.63), 3: (5, 32, 0.32), 4: (2, 2, 0.02), 5: (5, 0, 0.0)}
    assert {(r["target"], r["who"]) for r in proportional_sample(df.repartition(5, F.rand(1)), wanted, ["c"], "who", "rec", 100)[0].collect()} == {(r["target"], r["who"]) for r in got}
