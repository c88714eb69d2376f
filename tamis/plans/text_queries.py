"""Queries of the SQL text functions (FN, FLT10, FLT11, G22) over the records' statements and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import sqltext as S
from tamis.functions.sqlparse import with_hardness
from tamis.operators.metrics import concentration, prevalence
from tamis.session import table

_Q = r"""'[^']*(?:''[^']*)*'?|"[^"]*(?:""[^"]*)*"?|`[^`]*(?:``[^`]*)*`?"""


def _esc(s: str) -> str:
    return s.replace("'", "''")


def _norm(x: str) -> str:
    one = f"regexp_replace({x}, '({_esc(_Q)})|\\s*(,)', '\\1\\2', 'g')"
    two = f"regexp_replace({one}, '((?:{_esc(_Q)}|[^\\s''\"`])+)\\s*', '\\1 ', 'g')"
    return f"regexp_replace({two}, '^\\s+|\\s+$', '', 'g')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean(x: str) -> str:
    t = f"regexp_replace({_trim(x)}, '(?is)^\\s*<think>.*?</think>\\s*', '')"
    t = f"regexp_replace({t}, '(?i)^```(?:sqlite|sql)?\\s*', '')"
    t = _trim(f"regexp_replace({t}, '\\s*```$', '')")
    t = f"regexp_replace({t}, '(?i)^SQL(?:Query)?\\s*:\\s*', '')"
    return _norm(f"regexp_replace({t}, ';+$', '')")


_KW = ", ".join(f"'{k}'" for k in S.KEYWORDS)
_SKEL = (
    "array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[; ]+$', ''), '''[^'']*''|\"[^\"]*\"|\\b[0-9]+(?:\\.[0-9]+)?\\b', 'V', 'g'), '\\bas t[0-9]\\b|\\bt[0-9]\\.', '', 'g'),"
    " '[a-z_][a-z_0-9]*|[^\\sa-z_]'), lambda w: CASE WHEN NOT regexp_matches(w, '^[a-z_]') OR w IN (" + _KW + ") THEN w ELSE 'x' END), ' ')"
)
_CLASS = (
    "CASE WHEN regexp_matches(lower({x}), '\\b(union|intersect|except)\\b') THEN 'set_op' ELSE concat_ws('+',"
    " CASE WHEN len(regexp_extract_all(lower({x}), '\\bjoin\\b')) >= 2 THEN 'join2+' WHEN len(regexp_extract_all(lower({x}), '\\bjoin\\b')) = 1 THEN 'join1' ELSE 'single' END,"
    " CASE WHEN regexp_matches(lower({x}), '\\(\\s*select\\b') THEN 'nested' END, CASE WHEN contains(lower({x}), ' having ') THEN 'having' WHEN contains(lower({x}), ' group by ') THEN 'group' END,"
    " CASE WHEN regexp_matches(lower({x}), '\\border by\\b') THEN 'order' END) END"
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, fn: Column, sql: str, alias: str, key: str = "rec_id", source: str = "d_retry_corrected", where: str = "sql IS NOT NULL") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).where(where).select(key, fn().alias(alias))

    QUERIES[name] = query
    ORACLE[name] = f"SELECT {key}, {sql} AS {alias} FROM {source} WHERE {where}"


_sql = lambda f: lambda: f(F.col("sql"))
_add("fn01_normalize_sql", _sql(S.normalize_sql), _norm("sql"), "normalized")
_add("fn02_clean_sql", _sql(S.clean_sql), _clean("sql"), "cleaned")
_add("fn03_token_count", _sql(S.token_count), r"""len(regexp_extract_all(sql, '''(?:''''|[^''])*''|"(?:""|[^"])*"|`[^`]*`|[\pL\pN_]+|<=|>=|<>|!=|==|[-+*/(),.;=<>]'))::INT""", "tokens")
_add("fn06_question_key", lambda: S.question_key(F.col("question")), r"regexp_replace(replace(lower(regexp_replace(question, '[\s\x{00A0}\x{202F}]+', ' ', 'g')), 'ß', 'ss'), '^[ .?!…]+|[ .?!…]+$', '', 'g')", "question_key", where="question IS NOT NULL")
_add("fn07_skeleton", _sql(S.skeleton), _SKEL.format(x="sql"), "skeleton")
_add("fn08_structure_class", _sql(S.structure_class), _CLASS.format(x="sql"), "structure")
_add("fn11_tautology", _sql(S.is_tautology), r"""(regexp_extract(sql, '(?i)from (\w+)\s+where (\w+) in \(\s*select (\w+) from (\w+)\s*\)', 1) <> ''
  AND lower(regexp_extract(sql, '(?i)from (\w+)\s+where (\w+) in \(\s*select (\w+) from (\w+)\s*\)', 1)) = lower(regexp_extract(sql, '(?i)from (\w+)\s+where (\w+) in \(\s*select (\w+) from (\w+)\s*\)', 4))
  AND lower(regexp_extract(sql, '(?i)from (\w+)\s+where (\w+) in \(\s*select (\w+) from (\w+)\s*\)', 2)) = lower(regexp_extract(sql, '(?i)from (\w+)\s+where (\w+) in \(\s*select (\w+) from (\w+)\s*\)', 3)))""", "tautology")  # fmt: skip
_add("fn12_same_table_subquery", _sql(S.same_table_unfiltered_subquery), r"len(list_filter(regexp_extract_all(sql, '(?i)\bin\s*\(\s*select\s+[\w.]+\s+from\s+(\w+)\s*\)', 1), lambda t: lower(t) = lower(regexp_extract(sql, '(?i)\bfrom\s+(\w+)', 1)))) > 0", "same_table")
_add("fn13_superfluous_join", _sql(S.superfluous_join), r"len(list_filter(regexp_extract_all(lower(sql), '\bjoin\s+\w+\s+as\s+(t[0-9])\b', 1), lambda a: len(list_filter(regexp_extract_all(lower(sql), '\b(t[0-9])\.', 1), lambda b: b = a)) <= 1)) > 0 AND NOT regexp_matches(sql, '(?i)\bgroup by\b')", "superfluous")
_add("fn14_has_order_by", _sql(S.has_order_by), r"regexp_matches(sql, '(?i)\border\s+by\b')", "ordered")
_add("flt11_guard_scorer", _sql(S.guard_scorer), r"(starts_with(upper(ltrim(sql, E' \n\t\r')), 'SELECT ') OR starts_with(upper(ltrim(sql, E' \n\t\r')), 'WITH ') OR upper(ltrim(sql, E' \n\t\r')) IN ('SELECT', 'WITH'))", "read_only")
_add("flt11_guard_checker", _sql(S.guard_checker), r"regexp_matches(sql, '(?i)^\s*(select|with)\b')", "read_only")
_add("flt11_guard_rescorer", _sql(S.guard_rescorer), r"(starts_with(upper(ltrim(sql, E' \n\t\r')), 'SELECT') OR starts_with(upper(ltrim(sql, E' \n\t\r')), 'WITH'))", "read_only")
_add("fn16_repair_split", lambda: S.repair_split(F.col("id"), "retry"), r"CASE WHEN regexp_extract(id, ':([0-9]+)$', 1) <> '' THEN 'retry:' || regexp_extract(id, ':([0-9]+)$', 1) ELSE id END", "repaired", where="id IS NOT NULL")
_add("fn19_lower_equal", lambda: F.lower("question") == F.lower("question_originale"), "lower(question) = lower(question_originale)", "same", where="question_originale IS NOT NULL")


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "db_catalogue").select("db_id", S.policy(F.col("schema"), "CREATE TABLE").alias("allowed"))


QUERIES["flt10_statement_policy"] = _policy
ORACLE["flt10_statement_policy"] = r"""WITH p AS (SELECT db_id, list_filter(list_transform(string_split(schema, ';'), lambda s: trim(s, E' ')), lambda s: s <> '') AS p FROM db_catalogue)
SELECT db_id, len(p) > 0 AND len(list_filter(p, lambda s: NOT (starts_with(upper(trim(s, E' \n')), 'CREATE TABLE') AND NOT regexp_matches(s, '(?i)\b(insert|update|delete|drop|alter|attach|detach|pragma|vacuum|replace|trigger)\b')))) = 0 AS allowed FROM p"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "d_retry_corrected").where("question_originale IS NOT NULL")
    return d.select("rec_id", (S.number_list(F.col("question")) == S.number_list(F.col("question_originale"))).alias("same_numbers"), F.array_join(S.number_list(F.col("question")), "|").alias("numbers"))


def numbers_sql(text: str) -> str:
    """The same told without look-around: accents are taken off first, so that a word's edge is one for every letter."""
    bare = f"replace(strip_accents(coalesce({text}, '')), 'œ', 'o')"
    found = f"list_transform(regexp_extract_all({bare}, '(?i)\\b(?:[0-9]{{1,3}}(?:[ \\x{{00A0}}][0-9]{{3}})+|[0-9]+)(?:[.,][0-9]+)?(?:st|nd|rd|th|e|er|eme|s)?\\b'), lambda x: replace(replace(replace(regexp_replace(x, '(?i)(st|nd|rd|th|e|er|eme|s)$', ''), ',', '.'), ' ', ''), chr(160), ''))"
    ones = [f"len(regexp_extract_all({bare}, '{p}'))" for p in (r"(?i)\b(?:plus|moins)\s+d[’\x27](?:une|un)\b", r"(?i)\b(?:more|less)\s+than\s+one\b", r"(?i)\b(?:a\s+)?single\b")]
    return f"list_sort(list_concat({found}, list_transform(range({' + '.join(ones)}), lambda x: '1')))"


QUERIES["fn04_number_multiset"] = _numbers
ORACLE["fn04_number_multiset"] = f"SELECT rec_id, {numbers_sql('question')} = {numbers_sql('question_originale')} AS same_numbers, array_to_string({numbers_sql('question')}, '|') AS numbers FROM d_retry_corrected WHERE question_originale IS NOT NULL"


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence(table(spark, sf_dir, "d_retry_corrected").where("sql IS NOT NULL"), S.query_types(F.col("sql")))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence(table(spark, sf_dir, "d_retry_corrected").where("sql IS NOT NULL"), S.feature_flags(F.col("sql")))


def _prevalence_sql(flags: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, 100 * avg(({e})::INT) AS percent FROM d_retry_corrected WHERE sql IS NOT NULL" for n, e in flags.items())


_match = lambda p: f"regexp_matches(sql, '(?is){p}')"
QUERIES["fn09_query_types"] = _types
ORACLE["fn09_query_types"] = _prevalence_sql({"one_table": f"NOT {_match(S.QUERY_TYPES['join'])}", **{n: _match(p) for n, p in S.QUERY_TYPES.items()}, "joins2": r"len(regexp_extract_all(sql, '(?i)\bjoin\b')) >= 2"})
QUERIES["agg12_feature_prevalence"] = _features
ORACLE["agg12_feature_prevalence"] = _prevalence_sql({n: _match(p) for n, p in S.FEATURES.items()})


def _concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentration(table(spark, sf_dir, "d_retry_corrected").where("sql IS NOT NULL"), S.skeleton(F.col("sql")), [1, 10])


QUERIES["agg13_concentration"] = _concentration
ORACLE["agg13_concentration"] = f"""WITH g AS (SELECT {_SKEL.format(x="sql")} AS g, count(*) AS n FROM d_retry_corrected WHERE sql IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, g) AS r FROM g)
SELECT sum(n)::BIGINT AS rows, count(*) AS groups, 100.0 * sum(n) FILTER (r <= 1) / sum(n) AS top1_share, 100.0 * sum(n) FILTER (r <= 10) / sum(n) AS top10_share FROM r"""


def _distinct_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "d_retry_corrected").where("sql IS NOT NULL")
    return d.agg(F.countDistinct(S.structure_class(F.col("sql"))).alias("structures"), F.countDistinct(S.skeleton(F.col("sql"))).alias("skeletons"), F.countDistinct("id").alias("ids"))


QUERIES["agg03_distinct_counts"] = _distinct_structures
ORACLE["agg03_distinct_counts"] = f"SELECT count(DISTINCT {_CLASS.format(x='sql')}) AS structures, count(DISTINCT {_SKEL.format(x='sql')}) AS skeletons, count(DISTINCT id) AS ids FROM d_retry_corrected WHERE sql IS NOT NULL"


def _hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "d_retry_corrected").select("rec_id", S.clean_sql(F.col("sql")).alias("statement"), "schema")
    return with_hardness(d, "statement", "schema").select("rec_id", "parsed_hardness")


QUERIES["g22_hardness"] = _hardness  # a recursive parser: tested with golden statements
QUERIES["g22_hardness_counts"] = lambda spark, sf_dir: _hardness(spark, sf_dir).groupBy("parsed_hardness").agg(F.count("*").alias("records"))


def _syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit('near "'), F.substring("sql", 1, 5), F.lit('": syntax error'))).when(F.col("rec_id") % 3 == 1, F.concat(F.lit("no such column: "), F.col("db_id")))
    return table(spark, sf_dir, "d_retry_corrected").select("rec_id", S.is_syntax_error(message).alias("syntax"), F.coalesce(F.lower(message).contains("no such column"), F.lit(False)).alias("missing_column"))


QUERIES["fn15_syntax_error"] = _syntax
ORACLE["fn15_syntax_error"] = """SELECT rec_id, coalesce(contains(lower(m), 'syntax error'), false) AS syntax, coalesce(contains(lower(m), 'no such column'), false) AS missing_column
FROM (SELECT rec_id, CASE rec_id % 3 WHEN 0 THEN 'near "' || substr(sql, 1, 5) || '": syntax error' WHEN 1 THEN 'no such column: ' || db_id END AS m FROM d_retry_corrected)"""


def _id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.split("id", ":")
    return table(spark, sf_dir, "d_retry_corrected").select("rec_id", p[1].alias("db"), p[2].alias("level"), p[3].cast("int").alias("chunk"), F.substring_index("id", ":", -1).cast("int").alias("at"))


QUERIES["fn17_id_parts"] = _id_parts
ORACLE["fn17_id_parts"] = "SELECT rec_id, split_part(id, ':', 2) AS db, split_part(id, ':', 3) AS level, split_part(id, ':', 4)::INT AS chunk, split_part(id, ':', -1)::INT AS at FROM d_retry_corrected"


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "batch_responses").select("line_id", F.date_format("received_at", "yyyy-MM-dd_HH-mm-ss'Z'").alias("stamp"), F.regexp_replace("batch_file", "[^A-Za-z0-9._-]+", "-").alias("safe_name"))


QUERIES["fn20_stamp_and_safe_name"] = _stamps
ORACLE["fn20_stamp_and_safe_name"] = "SELECT line_id, strftime(received_at, '%Y-%m-%d_%H-%M-%SZ') AS stamp, regexp_replace(batch_file, '[^A-Za-z0-9._-]+', '-', 'g') AS safe_name FROM batch_responses"


def _math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.floor(v).alias("low"), F.ceil(v).alias("high"), F.rint(v).alias("near"), F.floor(v / 7).alias("quotient"), F.round(v, 2).alias("cents"))


QUERIES["fn24_math"] = _math
ORACLE["fn24_math"] = "SELECT event_id, floor(value)::BIGINT AS low, ceil(value)::BIGINT AS high, round_even(value, 0) AS near, floor(value / 7)::BIGINT AS quotient, round(value, 2) AS cents FROM events"


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.filter(F.coalesce("exemplars", F.array()), lambda x: x.isNotNull())
    hard = F.filter(e, lambda x: F.lower(F.trim(x["hardness"])) == "hard")
    return table(spark, sf_dir, "request_meta").select(
        "custom_id", "built_at", F.size(e).alias("n"), F.array_join(F.transform(F.slice(e, 1, 2), lambda x: F.coalesce(x["structure"], F.lit(""))), ",").alias("first_two"),
        F.coalesce(F.get(hard, F.lit(0))["sql"], F.lit("")).alias("first_hard"), F.array_join(F.transform(e, lambda x, i: F.concat(i + 1, F.lit("="), F.coalesce(x["hardness"], F.lit("")))), ";").alias("numbered"),
    )


QUERIES["fn25_array_functions"] = _arrays
ORACLE["fn25_array_functions"] = """WITH e AS (SELECT custom_id, built_at, list_filter(coalesce(exemplars, []), lambda x: x IS NOT NULL) AS e FROM request_meta)
SELECT custom_id, built_at, len(e)::INT AS n, coalesce(array_to_string(list_transform(e[1:2], lambda x: coalesce(x.structure, '')), ','), '') AS first_two, coalesce(list_filter(e, lambda x: lower(trim(x.hardness)) = 'hard')[1].sql, '') AS first_hard,
  coalesce(array_to_string(list_transform(e, lambda x, i: i || '=' || coalesce(x.hardness, '')), ';'), '') AS numbered FROM e"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.coalesce("hardness_counts", F.create_map().cast("map<string,int>"))
    entries = F.array_sort(F.transform(F.map_entries(F.map_filter(h, lambda k, v: v > 5)), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return table(spark, sf_dir, "seed_plan").select("db_id", F.coalesce(h["easy"], F.lit(0)).alias("easy"), F.aggregate(F.map_values(h), F.lit(0), lambda a, b: a + b).alias("total"), F.array_join(entries, ",").alias("common"))


QUERIES["fn26_map_functions"] = _maps
ORACLE["fn26_map_functions"] = """SELECT db_id, coalesce(hardness_counts['easy'], 0) AS easy, coalesce(list_sum(map_values(hardness_counts)), 0)::INT AS total,
  coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(hardness_counts), lambda x: x.value > 5), lambda x: x.key || '=' || x.value)), ','), '') AS common FROM seed_plan"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"))


QUERIES["fn21_json_fields"] = _events
ORACLE["fn21_json_fields"] = "SELECT event_id, (props->>'$.k')::BIGINT AS k, array_to_string(json_keys(props), ',') AS keys FROM events"


def _json_or_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is JSON in some rows and plain text in others."""
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(text, "k bigint")["k"], F.regexp_extract(text, "k=([0-9]+)", 1).cast("bigint")).alias("k"))


QUERIES["fn22_json_or_text"] = _json_or_text
ORACLE["fn22_json_or_text"] = "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events"
