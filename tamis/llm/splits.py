"""Splits that keep related records together.

Records are linked through shared entities (databases) and shared questions. Entities are the nodes: each question
links the first of its entities to the others, a star, so a question that a third of all rows share gives no pairs.
Boruvka rounds take each component's strongest edge (most shared questions, ties by name), add it to a spanning
forest kept as tables in the shared folder, and contract. Nodes, edges and components never reach the driver.

The groups are then dealt to the splits. Groups larger than a thousandth of all records, at most 999 of them, are dealt
one by one from the largest size band down, each to the split with the most room. All others are dealt systematically:
within each size band (powers of two) they stand in hash order on a line of their record counts, cut in proportion to
the room left, so each band is spread over the splits alike. The running sums go over 1024 hash buckets a band.

Null or empty questions link nothing; records whose entity is blank in every field form the group ''. Repeated rows
are records like others. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.words import word_text
from tamis.session import materialize

BUCKETS = 1024
LARGE = 1000


def question_links(records: DataFrame, entity: str, question: str) -> DataFrame:
    """Edges (u, v, w) between entities that share a question; w is the number of shared questions."""
    text = word_text(F.col(question))
    keyed = records.select(F.col(entity).alias("e"), text.alias("t")).where("t != ''")
    # 128 bits: two texts in a trillion collide with a chance of about 1e-15
    pairs = keyed.select("e", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2")).distinct()
    firsts = pairs.groupBy("h1", "h2").agg(F.min("e").alias("u"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(firsts, ["h1", "h2"]).where("e != u").groupBy("u", F.col("e").alias("v")).agg(F.count("*").alias("w"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def spanning_forest(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The forest's edges (u, v, w) and (node, root) of every node that has an edge."""
    best_edge = F.min(F.struct((-F.col("w")).alias("k"), "u", "v")).alias("e")
    left = materialize(edges.where("u != v").select(*_ordered(F.col("u"), F.col("v")), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"), "edges")
    labels = materialize(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    kept: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "w"))
        chosen = materialize(both.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("k"), "u", "v", "b")).alias("e")).select("a", F.col("e.b").alias("p"), "e.u", "e.v", (-F.col("e.k")).alias("w")), "chosen")
        kept.append(chosen.select("u", "v", "w").distinct())
        # Two components that chose each other form the only cycle of a tree; the lesser of them is its root.
        back = chosen.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parents = materialize(chosen.join(back, "p").select("a", F.when((F.col("pp") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p")), "parents")
        while True:
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(parents.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = materialize(labels.join(parents.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        to = lambda c: parents.select(F.col("a").alias(c), F.col("p").alias(f"{c}2"))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a2 != b2").select(*_ordered(F.col("a2"), F.col("b2")), "u", "v", "w")
        left = materialize(moved.groupBy("a", "b").agg(best_edge).select("a", "b", "e.u", "e.v", (-F.col("e.k")).alias("w")), "edges")
    return (reduce(DataFrame.unionByName, kept) if kept else None), labels


def entity_groups(records: DataFrame, entity: str, question: str) -> DataFrame:
    """(entity, group) for entities linked to others; the group is named by its first entity."""
    labels = spanning_forest(question_links(records, entity, question))[1]
    names = labels.groupBy("root").agg(F.min("node").alias("group"))
    return labels.join(names, "root").select(F.col("node").alias("entity"), "group")


def grouped_records(records: DataFrame, entity: str, question: str) -> DataFrame:
    """The records with the column group_db."""
    groups = entity_groups(records, entity, question).select(F.col("entity").alias("_entity"), F.col("group").alias("_group"))
    return records.join(groups, F.col(entity) == F.col("_entity"), "left").withColumn("group_db", F.coalesce("_group", entity, F.lit(""))).drop("_group", "_entity")


def deal_groups(sizes: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """(group, split) for groups (group, n); shares: the splits in order with their parts of 1."""
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    room = {s: share * total for s, share in shares}
    large = sizes.where(F.col("n") * LARGE > total).collect()
    dealt = []
    for r in sorted(large, key=lambda r: (-r["n"].bit_length(), -r["n"], r["group"])):
        split = max(room, key=lambda s: room[s])  # the first of equals
        room[split] -= r["n"]
        dealt.append((r["group"], split))
    one_by_one = spark.createDataFrame(dealt, "group string, split string")

    rest = sizes.where(F.col("n") * LARGE <= total).withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("h", F.xxhash64("group")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    buckets = rest.groupBy("band", "bucket").agg(F.sum("n").alias("m"))
    band = Window.partitionBy("band")
    buckets = buckets.select("band", "bucket", (F.sum("m").over(band.orderBy("bucket")) - F.col("m")).alias("before"), F.sum("m").over(band).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("band", "bucket").orderBy("h", "group"))
    place = rest.withColumn("inside", inside).join(buckets, ["band", "bucket"]).withColumn("at", (F.col("before") + F.col("inside") - F.col("n") / 2) / F.col("all"))
    open_room = {s: max(0.0, x) for s, x in room.items()}
    whole = sum(open_room.values())
    parts = [(s, open_room[s] / whole if whole else share) for s, share in shares]
    split, upper = F.lit(parts[-1][0]), 1.0
    for s, part in reversed(parts[:-1]):
        upper = sum(p for _, p in parts[: [x for x, _ in parts].index(s) + 1])
        split = F.when(F.col("at") < upper, s).otherwise(split)
    return one_by_one.unionByName(place.select("group", split.alias("split")))


def split_records(records: DataFrame, entity: str, question: str, shares: list[tuple[str, float]]) -> DataFrame:
    """The records with group_db and split."""
    grouped = materialize(grouped_records(records, entity, question), "grouped")  # the groups are found once
    sizes = materialize(grouped.groupBy(F.col("group_db").alias("group")).agg(F.count("*").alias("n")), "sizes")
    dealt = deal_groups(sizes, shares).withColumnRenamed("group", "_g")
    return grouped.join(dealt, F.col("group_db") == F.col("_g")).drop("_g")
