"""Metrics: rates, nearest-rank percentiles, breakdowns with totals, padding, throughput and energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import materialize


def rate(flag: Column) -> Column:
    """The share of true rows, nulls counting as false; 0 for no rows (AGG4)."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


def nearest_rank(column: str, q: float) -> Column:
    """The value at position ceil(n q) in order (AGG6); for groups whose different values fit a task, else nearest_ranks()."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def lower_rank(column: str, q: float) -> Column:
    """The value at index int(n q) - 1, at least the first (AGG7); for bounded groups, it gathers the values."""
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, F.greatest(F.lit(1), F.floor(F.size(values) * q).cast("int")))


def by_group_with_total(df: DataFrame, group: str, flags: dict[str, Column], total: str = "total") -> DataFrame:
    """Count and correct rows a group, and a total row (AGG10)."""
    d = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias(group), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    agg = [F.count("*").alias("n"), *(F.count_if(n).alias(n) for n in flags)]
    return d.rollup(group).agg(*agg).withColumn(group, F.coalesce(group, F.lit(total)))


def prevalence(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(feature, percent): how often each overlapping feature holds (AGG12)."""
    one = df.agg(*((100 * rate(c)).alias(n) for n, c in flags.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("percent")) for n in flags))).alias("x")).select("x.*")


def concentration(df: DataFrame, group: Column, tops: list[int]) -> DataFrame:
    """One row: rows, groups and the share of the largest groups (AGG13)."""
    counts = df.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    # rank by size within few coarse bands would not be exact; the largest ones are few, so a top-k order gives them
    top = counts.orderBy(F.col("n").desc(), "g").limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "g")))
    whole = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    sums = top.agg(*(F.sum(F.when(F.col("r") <= t, F.col("n"))).alias(f"top{t}") for t in tops))
    return whole.crossJoin(F.broadcast(sums)).select("rows", "groups", *((100 * F.col(f"top{t}") / F.col("rows")).alias(f"top{t}_share") for t in tops))


def length_batches(df: DataFrame, length: str, size: int, *order: str, by_length: bool = True) -> DataFrame:
    """Adds batch: consecutive rows, of like length first if asked (WIN10). Positions come from a two-level count."""
    keys = [F.col(length), *map(F.col, order)] if by_length else [*map(F.col, order)]
    return ranked(df, keys).withColumn("batch", F.floor((F.col("position") - 1) / size))


def cumulated(df: DataFrame, keys: list[Column], weight: Column) -> DataFrame:
    """Adds upto, the running sum of the weights in a total order, without bringing all rows to one task.

    Rows are range-partitioned by the order; each partition sums its own and adds the sums of those before it. The
    summed parts are written once, since a range partitioning computed twice need not cut at the same places.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    d = df.select("*", weight.alias("_w"), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    d = d.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_p", F.spark_partition_id())
    d = d.withColumn("_i", F.sum("_w").over(Window.partitionBy("_p").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)))
    d = materialize(d, "ranked")
    counts = d.groupBy("_p").agg(F.sum("_w").alias("_c"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(before.select("_p", "_before"), "_p").withColumn("upto", F.col("_i") + F.col("_before")).drop("_p", "_i", "_w", "_before", *names)


def ranked(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds position, 1 for the first row in a total order."""
    return cumulated(df, keys, F.lit(1).cast("bigint")).withColumnRenamed("upto", "position")


def ranked_within(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """Adds place, 1 for the first row of each group in a total order; a group of any size is spread over many tasks."""
    d = ranked(df, [*map(F.col, by), *keys])
    first = d.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by))).agg(F.min("position").alias("_first"))
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    return d.join(first, same).withColumn("place", F.col("position") - F.col("_first") + 1).drop("position", "_first", *(f"_b{i}" for i in range(len(by))))


def nearest_ranks(df: DataFrame, by: list[str], column: str, ranks: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of groups of any size (AGG6): values are counted, and the counts summed in order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    d = cumulated(counts, [*map(F.col, by), F.col("_v")], F.col("_n"))
    whole = d.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by))).agg(F.min(F.col("upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_all"))
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    reached = lambda q: F.col("upto") - F.col("_before") >= F.ceil(F.col("_all") * q)
    return d.join(whole, same).groupBy(*by).agg(*(F.min(F.when(reached(q), F.col("_v"))).alias(n) for n, q in ranks.items()))


def padding(batched: DataFrame, length: str) -> DataFrame:
    """One row: rows, batches, padded share of all slots, its mean and 95th percentile over batches (AGG17)."""
    each = batched.groupBy("batch").agg(F.count("*").alias("n"), F.sum(length).alias("used"), F.max(length).alias("longest"))
    each = each.withColumn("slots", F.col("n") * F.col("longest")).withColumn("waste", 1 - F.col("used") / F.col("slots"))
    return each.agg(F.sum("n").alias("rows"), F.count("*").alias("batches"), (1 - F.sum("used") / F.sum("slots")).alias("waste"), F.avg("waste").alias("mean_waste"), nearest_rank("waste", 0.95).alias("p95_waste"))


def energy_wh(watts: str, milliseconds: str) -> Column:
    """Mean power times the running time (AGG18)."""
    return F.avg(watts) * F.sum(milliseconds) / 3.6e6


def shortfall(targets: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """How far each group is below its target (AGG15)."""
    return targets.join(counts, by, "left").select(*by, F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("shortfall"))


def log_deltas(df: DataFrame, part: str, *order: str) -> DataFrame:
    """Steps and seconds since the previous log of the same part; logs that don't advance are skipped (WIN11)."""
    w = Window.partitionBy(part).orderBy(*order)
    d = df.withColumn("d_step", F.col("step") - F.lag("step").over(w)).withColumn("d_seconds", F.col("seconds") - F.lag("seconds").over(w))
    return d.where("d_step > 0 AND d_seconds > 0").withColumn("per_second", F.col("d_step") / F.col("d_seconds"))
