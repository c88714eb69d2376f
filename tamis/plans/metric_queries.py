"""Queries of aggregates, metrics and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import metrics as M
from tamis.operators import stats as T
from tamis.plans import text_queries
from tamis.plans.quota_queries import _LEVEL, _level
from tamis.plans.relational_queries import run_sql
from tamis.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def shared(name: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLE[name] = sql


_recs = lambda spark, sf_dir: table(spark, sf_dir, "d_retry_corrected")
_base, _cand = (lambda: F.lower("verdict") == "pass"), (lambda: F.col("recheck_verdict") == "pass")


@query("agg02_two_level_counts", f"""WITH c AS (SELECT coalesce(generation_mode, '') AS mode, {_LEVEL} AS level, count(*) AS n FROM d_retry_corrected GROUP BY ALL)
SELECT mode, string_agg(level || '=' || n, ',' ORDER BY level) AS levels FROM c GROUP BY mode""")  # fmt: skip
def agg02_two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _recs(spark, sf_dir).groupBy(F.coalesce("generation_mode", F.lit("")).alias("mode"), _level()).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("level", "n")))  # one entry a level
    return c.groupBy("mode").agg(F.array_join(F.transform(entries, lambda x: F.concat(x["level"], F.lit("="), x["n"].cast("string"))), ",").alias("levels"))


@query("agg04_rates", "SELECT count(*) AS n, coalesce(avg((lower(verdict) = 'pass' AND verdict IS NOT NULL)::INT), 0) AS passed, coalesce(avg(coalesce(recheck_verdict = 'pass', false)::INT), 0) AS repassed FROM d_retry_corrected")
def agg04_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recs(spark, sf_dir).agg(F.count("*").alias("n"), M.rate(_base()).alias("passed"), M.rate(_cand()).alias("repassed"))


shared("agg05_rounded_means", "SELECT event_type, round(avg(value), 2) AS mean FROM events GROUP BY event_type")


@query("agg06_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def agg06_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_ranks(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("agg07_lower_rank_p95", "SELECT source, list_sort(list(n_chars))[greatest(1, floor(count(*) * 0.95)::INT)] AS p95 FROM documents GROUP BY source")
def agg07_lower_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternate index int(n q) - 1, read off the counts of each length rather than a list of all rows."""
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source")
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy("n_chars"))).withColumn("n", F.sum("c").over(w))
    return placed.where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))).groupBy("source").agg(F.min("n_chars").alias("p95"))


shared("agg08_median_max", "SELECT source, median(n_chars) AS mid, max(n_chars) AS longest FROM documents GROUP BY source")


@query("agg09_arg_extremes", "SELECT db_id, arg_max(rec_id, (length(question), -rec_id)) AS longest, arg_min(rec_id, (length(question), rec_id)) AS shortest FROM d_retry_corrected WHERE db_id IS NOT NULL GROUP BY db_id")
def agg09_arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("question")
    return _recs(spark, sf_dir).where("db_id IS NOT NULL").groupBy("db_id").agg(F.max_by("rec_id", F.struct(n, -F.col("rec_id"))).alias("longest"), F.min_by("rec_id", F.struct(n, F.col("rec_id"))).alias("shortest"))


@query("agg10_by_hardness_with_total", f"""WITH d AS (SELECT {_LEVEL} AS level, coalesce(lower(verdict) = 'pass', false) AS b, coalesce(recheck_verdict = 'pass', false) AS c FROM d_retry_corrected)
SELECT CASE WHEN grouping(level) = 1 THEN 'total' ELSE level END AS level, count(*) AS n, count(*) FILTER (b) AS base, count(*) FILTER (c) AS candidate FROM d GROUP BY GROUPING SETS ((level), ())""")  # fmt: skip
def agg10_by_hardness_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_group_with_total(_recs(spark, sf_dir).withColumn("level", _level()), "level", {"base": _base(), "candidate": _cand()})


@query("agg11_overlapping_categories", r"""WITH d AS (SELECT coalesce(recheck_verdict = 'pass', false)::INT AS ok, list_filter([CASE WHEN regexp_matches(sql, '(?i)\bjoin\b') THEN 'join' END, CASE WHEN regexp_matches(sql, '(?i)\bgroup by\b') THEN 'group_by' END, CASE WHEN regexp_matches(sql, '(?is)\(\s*select\b') THEN 'subquery' END], lambda x: x IS NOT NULL) AS c FROM d_retry_corrected WHERE sql IS NOT NULL)
SELECT category, avg(ok) AS accuracy FROM (SELECT ok, unnest(c) AS category FROM d) GROUP BY category""")  # fmt: skip
def agg11_overlapping_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.functions.sqltext import query_types

    flags = query_types(F.col("sql"))
    names = F.array_compact(F.array(*(F.when(flags[n], F.lit(n)) for n in ("join", "group_by", "subquery"))))
    d = _recs(spark, sf_dir).where("sql IS NOT NULL").select(F.coalesce(_cand(), F.lit(False)).cast("int").alias("ok"), F.explode(names).alias("category"))
    return d.groupBy("category").agg(F.avg("ok").alias("accuracy"))


@query("agg14_degeneracy_gate", f"""WITH c AS ({text_queries.ORACLE["agg13_concentration"]}), s AS (SELECT same_table FROM ({text_queries.ORACLE["fn12_same_table_subquery"]})),
f AS (SELECT 100 * avg(regexp_matches(sql, '(?i)\\bjoin\\b')::INT) AS joins, 100 * avg(regexp_matches(sql, '(?is)\\(\\s*select\\b')::INT) AS nested FROM d_retry_corrected WHERE sql IS NOT NULL), t AS (SELECT 100 * avg(same_table::INT) AS same FROM s)
SELECT rows, groups, array_to_string(list_filter([CASE WHEN 100.0 * groups / rows < 20 THEN 'few_skeletons' END, CASE WHEN top10_share > 35 THEN 'concentrated' END, CASE WHEN joins < 5 THEN 'few_joins' END, CASE WHEN nested < 2 THEN 'few_nested' END, CASE WHEN same > 3 THEN 'same_table' END], lambda x: x IS NOT NULL), ',') AS failures FROM c, f, t""")  # fmt: skip
def agg14_degeneracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against the records as a training lot: thresholds over concentration and prevalence."""
    from tamis.functions.sqltext import feature_flags, same_table_unfiltered_subquery, skeleton

    d = _recs(spark, sf_dir).where("sql IS NOT NULL")
    shares = M.concentration(d, skeleton(F.col("sql")), [10])
    f = feature_flags(F.col("sql"))
    rates = d.agg((100 * M.rate(f["join"])).alias("joins"), (100 * M.rate(f["subquery"])).alias("nested"), (100 * M.rate(same_table_unfiltered_subquery(F.col("sql")))).alias("same_table"))
    checks = [("few_skeletons", 100 * F.col("groups") / F.col("rows") < 20), ("concentrated", F.col("top10_share") > 35), ("few_joins", F.col("joins") < 5), ("few_nested", F.col("nested") < 2), ("same_table", F.col("same_table") > 3)]
    return shares.crossJoin(F.broadcast(rates)).select("rows", "groups", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks))), ",").alias("failures"))


@query("agg15_shortfall", "SELECT s.db_id, greatest(s.target_quota - coalesce(n, 0), 0)::BIGINT AS shortfall FROM seed_plan s LEFT JOIN (SELECT db_id, count(*) AS n FROM d_retry_corrected GROUP BY db_id) USING (db_id)")
def agg15_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _recs(spark, sf_dir).groupBy("db_id").agg(F.count("*").alias("n"))
    return M.shortfall(table(spark, sf_dir, "seed_plan").select("db_id", F.col("target_quota").cast("bigint").alias("target")), counts, ["db_id"])


@query("agg16_usage_sums", """WITH u AS (SELECT raw::JSON->'$.response.body.usage' AS u FROM batch_responses WHERE json_valid(raw))
SELECT sum(try_cast(u->>'$.input_tokens' AS BIGINT))::BIGINT AS input_tokens, sum(try_cast(u->>'$.output_tokens' AS BIGINT))::BIGINT AS output_tokens, count(u->>'$.total_tokens') AS answered FROM u""")  # fmt: skip
def agg16_usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("raw")
    n = lambda k: F.try_variant_get(v, f"$.response.body.usage.{k}", "bigint")
    return table(spark, sf_dir, "batch_responses").agg(F.sum(n("input_tokens")).alias("input_tokens"), F.sum(n("output_tokens")).alias("output_tokens"), F.count(n("total_tokens")).alias("answered"))


def _padding_sql(order: str) -> str:
    return f"""WITH b AS (SELECT n_chars, (row_number() OVER (ORDER BY {order}) - 1) // 16 AS batch FROM documents), e AS (SELECT count(*) AS n, sum(n_chars) AS used, max(n_chars) AS longest FROM b GROUP BY batch)
SELECT sum(n)::BIGINT AS rows, count(*) AS batches, 1 - sum(used) / sum(n * longest) AS waste, avg(1 - used / (n * longest)) AS mean_waste, quantile_disc(1 - used / (n * longest), 0.95) AS p95_waste FROM e"""


@query("agg17_padding_waste", _padding_sql("doc_id"))
def agg17_padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.padding(M.length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 16, "doc_id", by_length=False), "n_chars")


@query("win10_padding_by_length", _padding_sql("n_chars, doc_id"))
def win10_padding_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.padding(M.length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 16, "doc_id"), "n_chars")


@query("agg18_energy", "SELECT event_type, avg(value) AS mean_watts, max(value) AS peak, avg(value) * sum(value * 10) / 3.6e6 AS wh FROM events GROUP BY event_type")
def agg18_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumn("ms", F.col("value") * 10)
    return d.groupBy("event_type").agg(F.avg("value").alias("mean_watts"), F.max("value").alias("peak"), M.energy_wh("value", "ms").alias("wh"))


@query("agg19_throughput", "SELECT source, count(*) * 1000.0 / sum(n_chars) AS per_second, sum(coalesce(announced_bytes, n_chars)) * 1.0 / count(*) AS mean_tokens, avg((n_chars >= 600)::INT) AS truncation_rate FROM documents GROUP BY source")
def agg19_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg((F.count("*") * 1000.0 / F.sum("n_chars")).alias("per_second"), (F.sum(F.coalesce("announced_bytes", "n_chars")) * 1.0 / F.count("*")).alias("mean_tokens"), M.rate(F.col("n_chars") >= 600).alias("truncation_rate"))


_PAIR = "SELECT coalesce(lower(verdict) = 'pass', false) AS b, coalesce(recheck_verdict = 'pass', false) AS c FROM d_retry_corrected"


@query("agg20_paired", f"SELECT count(*) AS n, count(*) FILTER (c AND NOT b) AS gained, count(*) FILTER (b AND NOT c) AS lost, 100.0 * (count(*) FILTER (c AND NOT b) - count(*) FILTER (b AND NOT c)) / count(*) AS delta_points FROM ({_PAIR})")
def agg20_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.paired(_recs(spark, sf_dir), _base(), _cand())


@query("agg21_mcnemar", f"""WITH g AS (SELECT coalesce(generation_mode, '') AS mode, count(*) FILTER (c AND NOT b) AS g, count(*) FILTER (b AND NOT c) AS l FROM (SELECT generation_mode, coalesce(lower(verdict) = 'pass', false) AS b, coalesce(recheck_verdict = 'pass', false) AS c FROM d_retry_corrected) GROUP BY 1),
j AS (SELECT mode, g, l, unnest(range(0, least(g, l) + 1)) AS j FROM g)
SELECT mode, g AS gained, l AS lost, round(least(1, 2 * sum(exp(lgamma(g + l + 1) - lgamma(j + 1) - lgamma(g + l - j + 1) - (g + l) * ln(2)))), 9) AS p FROM j GROUP BY ALL""")  # fmt: skip
def agg21_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = F.coalesce(_base(), F.lit(False)), F.coalesce(_cand(), F.lit(False))
    d = _recs(spark, sf_dir).groupBy(F.coalesce("generation_mode", F.lit("")).alias("mode")).agg(F.count_if(c & ~b).alias("gained"), F.count_if(b & ~c).alias("lost"))
    return d.withColumn("p", F.round(T.mcnemar(F.col("gained"), F.col("lost")), 9))


@query("agg22_cluster_bootstrap", """WITH d AS (SELECT split_part(id, ':', 2) AS c, coalesce(recheck_verdict = 'pass', false)::INT - coalesce(lower(verdict) = 'pass', false)::INT AS d FROM d_retry_corrected),
p AS (SELECT c, sum(d) AS s, count(*) AS n, row_number() OVER (ORDER BY c) - 1 AS i FROM d GROUP BY c), k AS (SELECT count(*) AS k FROM p),
s AS (SELECT rep, slot, k FROM k, unnest(range(0, 200)) r(rep), unnest(range(0, k)) t(slot)), m AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || slot), 1, 8))::BIGINT % k AS i FROM s),
b AS (SELECT rep, sum(s) / sum(n) AS mean FROM m JOIN p USING (i) GROUP BY rep), v AS (SELECT list_sort(list(mean)) AS v FROM b)
SELECT (SELECT sum(s) / sum(n) FROM p) AS mean, v[6] AS low, v[195] AS high FROM v""")  # fmt: skip
def agg22_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = F.coalesce(_cand(), F.lit(False)).cast("int") - F.coalesce(_base(), F.lit(False)).cast("int")
    return T.cluster_bootstrap(_recs(spark, sf_dir).withColumn("c", F.split("id", ":")[1]), "c", diff, 200, 42)


shared("agg23_intersections", "SELECT count(*) AS n, CAST(sum(CASE WHEN lower(verdict) = 'fail' AND recheck_verdict = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS twice_failed FROM d_retry_corrected")


@query("agg24_collected_groups", "SELECT custom_id, string_agg(built_at::VARCHAR, ';' ORDER BY built_at) AS stamps, count(*) AS n FROM request_meta GROUP BY custom_id")
def agg24_collected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the times they were built; a request is repeated a few times, so the lists stay short."""
    stamp = F.rtrim(F.date_format("built_at", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "request_meta").groupBy("custom_id").agg(F.array_join(F.array_sort(F.collect_list(stamp)), ";").alias("stamps"), F.count("*").alias("n"))


shared("agg25_all_any", "SELECT db_id, bool_and(coalesce(verdict, '') <> 'pass') AS none_passed, bool_or(coalesce(recheck_verdict, '') = 'pass') AS some_repassed FROM d_retry_corrected GROUP BY db_id")


@query("win11_log_deltas", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS step, epoch(ts)::DOUBLE AS seconds FROM events),
d AS (SELECT user_id, event_id, step - lag(step) OVER w AS d_step, seconds - lag(seconds) OVER w AS d_seconds FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, event_id, d_step, round(d_seconds, 3) AS d_seconds, round(d_step / d_seconds, 6) AS per_second FROM d WHERE d_step > 0 AND d_seconds > 0""")  # fmt: skip
def win11_log_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    logs = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) * 10).cast("bigint").alias("step"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return M.log_deltas(logs, "user_id", "step").select("user_id", "event_id", "d_step", F.round("d_seconds", 3).alias("d_seconds"), F.round("per_second", 6).alias("per_second"))


shared("fn23_formatted_units", "SELECT doc_id, round(n_chars / CAST(1024 AS DOUBLE), 2) AS kib, concat(CAST(CAST(round(100.0 * n_chars / 16384) AS INT) AS STRING), ' %') AS fill FROM documents")
