"""A sample whose categories follow given proportions, from mergeable reservoirs.

Each wanted category keeps the records with the smallest hashes of their identity, as many as its capacity: a reservoir
that merges by keeping the smallest of both, so one pass over each partition and a tree of merges give the same sample in
whatever order rows come. Records of one identity (delivered again) hash alike and count once.

The quotas asked for are the targets' shares of the sample, rounded, and at least their minimum. Reservoirs are HEADROOM
times larger. From their final counts come the feasible quotas: what short categories can't fill is given to the others
by their shares, never below a minimum, so that the sample has the size asked for as long as the targets' records suffice
and the minimums leave room. All reservoirs are trimmed to them. If one that was full should give more than it
holds, the pass is repeated with larger ones.

A reservoir of capacity c holds min(c, distinct records) rows, so one below its capacity tells exactly how many records
a target has. Ties of hashes are broken by identity. Records with null category or identity are in no category;
targets with null values match nothing and are reported; an empty table leaves every positive target short; further
columns are not read. Targets (a few rows) are broadcast up to MAX_TARGETS, beyond which they are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import materialize

MAX_TARGETS = 10_000
SALTS = 16
BUCKET_BITS = 12
HEADROOM = 2


def _keep(capacity: str):
    """The rows of smallest hash of each target, one for each identity; columns target, h, who and others."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        most = 50_000
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > most:
                held = _smallest(held, capacity)
                most = max(50_000, 2 * held.num_rows)
        if held is not None and held.num_rows:
            yield from _smallest(held, capacity).combine_chunks().to_batches()

    return keep


def _smallest(table: pa.Table, capacity: str) -> pa.Table:
    table = table.sort_by([("target", "ascending"), ("h", "ascending"), ("who", "ascending"), ("rec", "ascending")])
    target, h = table.column("target").to_numpy(), table.column("h").to_numpy()
    who = table.column("who").combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else np.zeros(0, np.int64)
    who = np.asarray(who)
    new = np.ones(len(target), bool)
    new[1:] = (target[1:] != target[:-1]) | (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    first = np.ones(len(target), bool)
    first[1:] = target[1:] != target[:-1]
    rank = np.cumsum(new)
    rank = rank - np.repeat(rank[first], np.diff(np.append(np.flatnonzero(first), len(target)))) + 1
    return table.filter(pa.array(new & (rank <= table.column(capacity).to_numpy())))


def reservoirs(records: DataFrame, targets: DataFrame, categories: list[str], identity: str, key: str) -> DataFrame:
    """(target, h, who, rec, quota): at most quota records of each target.

    targets: target, the category columns, quota; records: the category columns, identity and key.
    """
    small = targets.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS
    wanted = targets.select(*categories, F.col("target"), F.col("quota").cast("int").alias("quota")).where("quota > 0")
    joined = records.join(F.broadcast(wanted) if small else wanted, categories)
    rows = joined.where(F.col(identity).isNotNull()).select("target", F.xxhash64(identity).alias("h"), F.col(identity).alias("who"), F.col(key).alias("rec"), "quota")
    keep, schema = _keep("quota"), rows.schema
    part = rows.mapInArrow(keep, schema)  # one reservoir a target in each partition, of bounded size
    salted = part.repartition("target", F.pmod("h", F.lit(SALTS))).mapInArrow(keep, schema)
    return smallest(salted, "quota")


def smallest(rows: DataFrame, most: str) -> DataFrame:
    """The rows of smallest (h, who) of each target, as many as the column most tells; h spreads evenly.

    Rows are counted by 2^BUCKET_BITS ranges of h; whole ranges are taken until the one in which the number is reached, and only
    that range's rows are put in order, so no task holds a target's reservoir.
    """
    d = materialize(rows.withColumn("range", F.shiftright("h", 64 - BUCKET_BITS)), "parts")
    counts = d.groupBy("target", "range").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("target").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 2^BUCKET_BITS rows a target
    told = d.join(before, ["target", "range"]).where(F.col("before") < F.col(most))
    inside = F.row_number().over(Window.partitionBy("target", "range").orderBy("h", "who"))
    return told.withColumn("inside", inside).where(F.col("before") + F.col("inside") <= F.col(most)).select(*rows.columns)


def quotas(targets: DataFrame, size: int) -> DataFrame:
    """Adds the quota: the rounded share of the sample, at least the minimum."""
    return targets.withColumn("quota", F.greatest(F.coalesce("min_rows", F.lit(0)), F.floor(F.coalesce("target_share", F.lit(0.0)) * size + 0.5 + 1e-9).cast("int")))


def feasible_quotas(shares: dict[int, float], least: dict[int, int], most: dict[int, int], size: int) -> dict[int, int]:
    """Quotas in proportion to the shares, at least `least` and at most `most`, that sum to size where the bounds let them.

    The dicts hold one entry a target: a planning table, not records.
    """
    low = {t: min(least[t], most[t]) for t in shares}
    high = {t: most[t] if shares[t] > 0 else low[t] for t in shares}
    if sum(low.values()) >= size:
        return low
    if sum(high.values()) <= size:
        return high
    at = lambda scale: {t: min(high[t], max(low[t], scale * shares[t])) for t in shares}
    below, above = 0.0, max(high[t] / shares[t] for t in shares if shares[t] > 0)
    for _ in range(200):
        middle = (below + above) / 2
        below, above = (middle, above) if sum(at(middle).values()) < size else (below, middle)
    exact = at(above)
    out = {t: int(x + 1e-9) for t, x in exact.items()}
    for t in sorted((t for t in out if out[t] < high[t]), key=lambda t: (out[t] - exact[t], t))[: max(0, size - sum(out.values()))]:
        out[t] += 1  # the largest remainders
    return out


def proportional_sample(records: DataFrame, targets: DataFrame, categories: list[str], identity: str, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The sample (target, h, who, rec) of size records, and (target, target_share, quota, drawn, achieved_share).

    targets: as quotas() gives them. The quota of the report is the one asked for, drawn the feasible one.
    """
    spark = records.sparkSession
    rows = targets.select("target", "quota", F.coalesce("min_rows", F.lit(0)).alias("least"), F.coalesce("target_share", F.lit(0.0)).alias("share")).collect()  # a planning table
    shares, least = {r["target"]: r["share"] for r in rows}, {r["target"]: r["least"] for r in rows}
    capacity = {r["target"]: HEADROOM * r["quota"] + 1 for r in rows}
    while True:
        wider = spark.createDataFrame(list(capacity.items()), f"target {dict(targets.dtypes)['target']}, quota int")
        held = materialize(reservoirs(records, targets.drop("quota").join(wider, "target"), categories, identity, key), "reservoirs")
        counts = {r["target"]: r["n"] for r in held.groupBy("target").agg(F.count("*").alias("n")).collect()}
        # a reservoir below its capacity holds all there are
        feasible = feasible_quotas(shares, least, {t: n if (n := counts.get(t, 0)) < c else max(size, least[t]) for t, c in capacity.items()}, size)
        if all(feasible[t] <= counts.get(t, 0) for t in feasible):
            break
        capacity = {t: max(c, HEADROOM * feasible[t] + 1) for t, c in capacity.items()}
    drawn = spark.createDataFrame(list(feasible.items()), f"target {dict(targets.dtypes)['target']}, drawn bigint")
    sample = smallest(held.join(F.broadcast(drawn), "target"), "drawn").select("target", "h", "who", "rec")
    achieved = F.col("drawn") / F.lit(max(1, sum(feasible.values())))
    return sample, targets.join(drawn, "target").select("target", "target_share", "quota", "drawn", achieved.alias("achieved_share"))


def target_report(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: quota, drawn and missing."""
    drawn = sample.groupBy("target").agg(F.count("*").alias("drawn"))
    counted = targets.join(drawn, "target", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return counted.select("target", "quota", "drawn", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)).cast("bigint").alias("missing"))
