"""Paired statistics of two runs: gained and lost, McNemar's exact test and a cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(df: DataFrame, base: Column, candidate: Column) -> DataFrame:
    """One row: n, gained, lost and the difference in points (AGG20)."""
    b, c = F.coalesce(base, F.lit(False)), F.coalesce(candidate, F.lit(False))
    d = df.agg(F.count("*").alias("n"), F.count_if(c & ~b).alias("gained"), F.count_if(b & ~c).alias("lost"))
    return d.withColumn("delta_points", 100 * (F.col("gained") - F.col("lost")) / F.greatest(F.col("n"), F.lit(1)))


def mcnemar(gained: Column, lost: Column) -> Column:
    """The exact two-sided p of a fair coin for the discordant pairs, in log space so that it can't underflow (AGG21)."""
    n, k = (gained + lost).cast("double"), F.least(gained, lost)
    # log C(n, j) grows by log((n - j) / (j + 1)); the terms are summed scaled by 2^-n each
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, j: F.struct((acc["term"] + F.log((n - j) / (j + 1))).alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def cluster_bootstrap(df: DataFrame, cluster: str, difference: Column, repeats: int, seed: int) -> DataFrame:
    """One row: the mean difference and its 95 % interval when whole clusters are drawn again (AGG22).

    Each repeat draws as many clusters as there are, by hash of seed, repeat and slot; only sums a cluster are joined.
    """
    per = df.groupBy(F.col(cluster).alias("c")).agg(F.sum(difference.cast("double")).alias("s"), F.count("*").alias("n"))
    from pyspark.sql import Window

    numbered = per.withColumn("i", F.row_number().over(Window.orderBy("c")) - 1)
    k = F.broadcast(per.agg(F.count("*").alias("k")))
    slots = df.sparkSession.range(repeats).crossJoin(k).select(F.col("id").alias("rep"), "k", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "rep", "slot")), 1, 8), 16, 10).cast("bigint") % F.col("k")
    drawn = slots.select("rep", pick.alias("i")).join(numbered, "i").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("mean"))
    low, high = max(1, round(repeats * 0.025) + 1), repeats - round(repeats * 0.025)
    order = F.array_sort(F.collect_list("mean"))  # one number a repeat
    ends = drawn.agg(order.alias("v")).select(F.element_at("v", low).alias("low"), F.element_at("v", high).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(F.broadcast(ends))
