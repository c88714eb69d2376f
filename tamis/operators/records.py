"""Record operators: validation, joins by id with contract checks, overrides, acceptance and chat records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.sqltext import number_list
from tamis.operators.metrics import ranked


class ContractError(ValueError):
    """A table breaks a contract of the pipeline."""


def missing_fields(fields: Iterable[str]) -> Column:
    """The names of required string fields that are null or blank."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.regexp_replace(f, r"(?U)\s+", ""), F.lit("")) == "", F.lit(f)) for f in fields)))


def require(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """Raises if a row breaks the condition, naming a few; else returns the table."""
    if bad := df.where(~F.coalesce(ok, F.lit(False))).take(5):
        raise ContractError(f"{what}: {bad}")
    return df


def question_issues(source: Column, question: Column) -> Column:
    """What a translated question lacks against its source (FLT2)."""
    s, q = F.coalesce(source, F.lit("")), F.coalesce(question, F.lit(""))
    checks = [
        ("numbers", number_list(s) != number_list(q)),
        ("percents", F.regexp_count(s, F.lit("%")) != F.regexp_count(q, F.lit("%"))),
        ("holds_sql", q.rlike(r"(?iU)\b(?:SELECT|FROM|WHERE|JOIN|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b")),
        ("no_letter", (F.trim(q) != "") & ~q.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key (WIN13); order must be total within a key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(o).desc_nulls_last() for o in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: list[str | Column], *order: str) -> DataFrame:
    """The first row of each key, in a total order (WIN1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def acceptance(verdict: Column, check: Column, corrected: Column) -> Column:
    """Null if a record is accepted, else why not (FLT4): a correction overrules, then the judge, then the check."""
    return F.when(corrected, None).when(verdict.isNotNull() & (verdict != "pass"), F.concat(F.lit("judge_"), verdict)).when((F.coalesce(check, F.lit("")) != "pass") & ~F.coalesce(verdict == "pass", F.lit(False)), "deterministic_fail")


def accept(records: DataFrame, checks: DataFrame, judgments: DataFrame, corrections: DataFrame, key: str = "id") -> DataFrame:
    """The records with the corrected question and reason (null if accepted); the sides have one row a key (JN4)."""
    fix = corrections.select(key, F.col("question").alias("_fix"))
    joined = records.join(checks.select(key, "status"), key, "left").join(judgments.select(key, "verdict"), key, "left").join(fix, key, "left")
    return joined.withColumn("reason", acceptance(F.col("verdict"), F.col("status"), F.col("_fix").isNotNull())).withColumn("question", F.coalesce("_fix", "question")).drop("_fix", "status", "verdict")


def upsert(base: DataFrame, override: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overrides on top of a base by key; rows of either side are kept (JN2, JN12)."""
    o = override.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    return base.join(o, key, "full_outer").select(key, *(F.coalesce(f"_o_{c}", c).alias(c) for c in columns))


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids of the left that the right lacks, and the reverse (JN3, JN11)."""
    a, b = left.select(key, F.lit(1).alias("_l")).distinct(), right.select(key, F.lit(1).alias("_r")).distinct()
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("extra"))


def paired_by_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables whose ids must be the same set."""
    d = id_differences(left, right, key).first()
    if d["missing"] or d["extra"]:
        raise ContractError(f"ids differ: {d['missing']} missing, {d['extra']} extra")
    return left.join(right, key)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows joined by position in two orders (JN6); the positions come from range partitions."""
    number = lambda df, o: ranked(df, [F.col(c) for c in o]).withColumn("ordinal", F.col("position") - 1).drop("position")
    return number(left, left_order).join(number(right, right_order), "ordinal")


def chat_record(system: str, question: Column, schema: Column, sql: Column) -> Column:
    """The three messages of a training example; the user's is a JSON object (PRJ3)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.to_json(F.struct(question.alias("question"), schema.alias("schema")))), message("assistant", sql))


def with_demonstrations(messages: Column, demonstrations: list[tuple[str, str]]) -> Column:
    """Few-shot pairs between the system message and the rest (PRJ5)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"))
    shots = [m for user, answer in demonstrations for m in (message("user", user), message("assistant", answer))]
    return F.concat(F.slice(messages, 1, 1), F.array(*shots), F.slice(messages, 2, 1_000_000)) if shots else messages


def contract_violations(messages: Column) -> Column:
    """What breaks the training contract of a chat record (FLT3)."""
    roles = F.transform(messages, lambda m: m["role"])
    user = messages[1]["content"]
    checks = [
        ("size", F.size(messages) != 3),
        ("roles", roles != F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))),
        ("keys", F.array_sort(F.coalesce(F.json_object_keys(user), F.array())) != F.array(F.lit("question"), F.lit("schema"))),
        ("blank", F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == "")),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of columns, keys sorted (FN18)."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def fingerprint_union(base: DataFrame, more: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """The base whole, then the first of each new fingerprint of the other table (SET2)."""
    b = base.select(*columns, F.lit("base").alias("origin"))
    new = keep_first(more.withColumn("_f", fingerprint(*columns)), ["_f"], *order)
    new = new.join(base.select(fingerprint(*columns).alias("_f")).distinct(), "_f", "left_anti")
    return b.unionByName(new.select(*columns, F.lit("added").alias("origin")))


def merged_rounds(rounds: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the latest round that passed for each key (JN13); rounds: key, value, verdict, oldest first."""
    every = [r.select(key, value, "verdict", F.lit(i).alias("round")) for i, r in enumerate(rounds)]
    union = every[0]
    for r in every[1:]:
        union = union.unionByName(r)
    return union.where("verdict = 'pass'").groupBy(key).agg(F.max_by(value, "round").alias(value), F.max("round").alias("round"))


def greedy_accept(df: DataFrame, key: Column, long_enough: Column, valid: Column, error: Column, *order: str) -> DataFrame:
    """Adds reason: null for the first valid row of each key, its own error before it, 'duplicate' after it (WIN2)."""
    d = df.withColumn("_k", key).withColumn("_long", long_enough).withColumn("_ok", valid & long_enough)
    # the first valid order of each key is a small aggregate, so rows of a frequent key needn't meet in one task
    first = d.where("_ok").groupBy(F.col("_k").alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    d = d.join(first, F.col("_k").eqNullSafe(F.col("_key")), "left")
    here = F.struct(*order)
    reason = F.when(~F.col("_long"), "too_short").when(here > F.col("_first"), "duplicate").when(~F.col("_ok"), error)
    return d.withColumn("reason", reason).drop("_k", "_long", "_ok", "_first", "_key")


def two_key_accept(df: DataFrame, group: str, first: Column, second: Column, order: list[str]) -> DataFrame:
    """Keeps a row unless its first or its second key was kept before in the group (WIN3).

    Each choice depends on the ones before it, so a group is walked in order, in constant memory a row; rows arrive
    sorted and stream, so a large group needs no more than its two sets of keys.
    """
    d = df.withColumn("_a", F.xxhash64(first)).withColumn("_b", F.xxhash64(second))
    at = d.columns.index(group), d.columns.index("_a"), d.columns.index("_b")

    def walk(batches):
        import pyarrow as pa

        now, a_seen, b_seen = None, set(), set()
        for batch in batches:
            keep = []
            for g, a, b in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if g != now:
                    now, a_seen, b_seen = g, set(), set()
                ok = a not in a_seen and b not in b_seen
                if ok:
                    a_seen.add(a)
                    b_seen.add(b)
                keep.append(ok)
            yield batch.filter(pa.array(keep))

    return d.repartition(group).sortWithinPartitions(group, *order).mapInArrow(walk, d.schema).drop("_a", "_b")
