import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import sqltext as S
from tamis.functions.sqlparse import SyntaxFault, catalog_of, classify, components, parse, tokens
from tamis.functions.words import name_key, plain, strict_name_key, word_text, words


def _run(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def by_hand_normalize(sql):
    """Blanks outside quotes, one character at a time."""
    out, quote, i = [], None, 0
    while i < len(sql):
        ch = sql[i]
        if quote:
            out.append(ch)
            if ch == quote:
                if sql[i + 1 : i + 2] == quote:
                    out.append(quote)
                    i += 1
                else:
                    quote = None
        elif ch in "'\"`":
            quote = ch
            out.append(ch)
        elif ch.isspace():
            if out and out[-1] != " ":
                out.append(" ")
        else:
            if ch == "," and out and out[-1] == " ":
                out.pop()
            out.append(ch)
        i += 1
    return "".join(out)


def test_normalize_sql_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ,'\"`\n") for _ in range(rng.randrange(14))) for _ in range(1500)]
    got = _run(spark, texts, S.normalize_sql)
    for t, g in zip(texts, got, strict=True):
        if not re.search(r"['\"`]", t):
            assert g == by_hand_normalize(t).strip(), t
        assert re.sub(r"\s", "", g) == re.sub(r"\s", "", t), t
    assert _run(spark, ["SELECT  a ,b\nFROM  t WHERE x = 'a  , b'  ", None, ""], S.normalize_sql) == ["SELECT a,b FROM t WHERE x = 'a  , b'", None, ""]


def test_clean_sql(spark):
    texts = ["```sql\nSELECT 1;\n```", "<think>x</think> SQLQuery: SELECT  a ;;", "<think>open SELECT 1", None, "SQL: select 'a;'"]
    assert _run(spark, texts, S.clean_sql) == ["SELECT 1", "SELECT a", "<think>open SELECT 1", None, "select 'a;'"]


def test_numbers(spark):
    texts = ["3,5 et 1 000 le 2nd", "more than one of a single 4th", "a1 b 2,", "plus d’un", ""]
    assert _run(spark, texts, S.number_list) == [["1000", "2", "3.5"], ["1", "1", "4"], ["2"], ["1"], []]


def test_keys_skeletons_and_classes(spark):
    assert _run(spark, ["  Où  EST-ce ?! ", "STRASSE …"], S.question_key) == ["où est-ce", "strasse"]
    assert _run(spark, ["SELECT T1.a FROM t AS T1 WHERE b = 'x' AND c > 1.5;"], S.skeleton) == ["select x from x where x = V and x > V"]
    texts = ["select a from t", "select a from t join u on x=y join v on x=y group by a order by a", "select a from t where a in ( select b from u)", "select a from t union select a from u", "select a from t group by a having count(*) > 1"]
    assert _run(spark, texts, S.structure_class) == ["single", "join2++group+order", "single+nested", "set_op", "single+having"]


def test_guards_differ(spark):
    texts = ["SELECT*FROM t", " select 1", "SELECTED", "with a as (select 1) select 1", "DELETE FROM t"]
    assert _run(spark, texts, S.guard_scorer) == [False, True, False, True, False]
    assert _run(spark, texts, S.guard_checker) == [True, True, False, True, False]
    assert _run(spark, texts, S.guard_rescorer) == [True, True, True, True, False]


def test_detectors(spark):
    assert _run(spark, ["select x from t where x in (select x from t)", "select x from t where x in (select y from t)"], S.is_tautology) == [True, False]
    assert _run(spark, ["select x from t where x in (select y from t)", "select x from t where x in (select y from t where z = 1)"], S.same_table_unfiltered_subquery) == [True, False]
    assert _run(spark, ["select t1.a from a as t1 join b as t2 on t1.i = t2.i", "select t2.a from a as t1 join b as t2 on t1.i = t2.i"], S.superfluous_join) == [True, False]
    assert _run(spark, ['near "x": syntax error', "no such column", None], S.is_syntax_error) == [True, False, False]
    assert _run(spark, ["train:4", "xx:9", "free"], lambda c: S.repair_split(c, "dev")) == ["dev:4", "dev:9", "free"]
    assert _run(spark, ["CREATE TABLE a (b INT); create table c (d INT)", "CREATE TABLE a (b INT); DROP TABLE a", ""], lambda c: S.policy(c, "CREATE TABLE")) == [True, False, False]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_words_are_runs(text):
    assert words(text) == re.findall("[a-z0-9]+", plain(text))


def test_native_words_agree(spark):
    texts = ["L'été à Łódź, n°5", "Ｘ ß œuvre", "áb", None, "", "ÀÉÎõü 12-3"]
    assert _run(spark, texts, word_text) == [" ".join(words(t)) for t in texts]


CATALOG = {"t": ["a", "b", "c"], "u": ["a", "d"]}


@pytest.mark.parametrize(
    ("sql", "level"),
    [
        ("SELECT a FROM t", "easy"), ("SELECT count(*) FROM t WHERE b = 'x'", "easy"), ("SELECT a, count(*) FROM t GROUP BY a", "medium"),
        ("SELECT T1.a FROM t AS T1 JOIN u AS T2 ON T1.a = T2.a", "easy"), ("SELECT a FROM t WHERE b = 'x' ORDER BY a LIMIT 1", "hard"),
        ("SELECT a FROM t WHERE a IN (SELECT a FROM u)", "hard"), ("SELECT a FROM t UNION SELECT a FROM u", "hard"),
        ("SELECT a, b FROM t WHERE a NOT IN (SELECT a FROM u WHERE d > 1) AND b = 'x'", "extra"),
    ],
)
def test_hardness(sql, level):
    assert classify(sql, CATALOG)[0] == level


@pytest.mark.parametrize(
    "sql",
    ["WITH x AS (SELECT a FROM t) SELECT a FROM x", "SELECT a FROM t LEFT JOIN u ON t.a = u.a", "SELECT a FROM t, u", "SELECT a FROM t WHERE b IS NULL", "SELECT a FROM t WHERE EXISTS (SELECT a FROM u)", "SELECT a FROM t WHERE a IN (1, 2)", "SELECT CASE WHEN a THEN b END FROM t",
     "SELECT CAST(a AS INT) FROM t", "SELECT a AS x FROM t", "SELECT a FROM t WHERE a <> 1", "SELECT a FROM t LIMIT x", "SELECT z FROM t", "SELECT a FROM nowhere", "SELECT 'a FROM t", "", "SELECT"],
)
def test_rejected(sql):
    with pytest.raises(SyntaxFault):
        parse(sql, CATALOG)


def test_quirks_of_counting():
    one = lambda s: components(parse(s, CATALOG))
    assert one("SELECT a FROM t WHERE b NOT LIKE 'x' AND c = 1")[2] == 1  # the connector counts in the length of WHERE
    assert one("SELECT a, b FROM t WHERE b NOT IN (SELECT a FROM u) AND NOT_ = 1".replace("NOT_ = 1", "c = 1"))[2] == 2
    assert one("SELECT max(a) FROM t GROUP BY b HAVING max(a) > 1 AND min(a) < 3")[2] == 1  # a connector in HAVING counts as an aggregate
    assert parse("SELECT a FROM t ORDER BY a ASC, b DESC", CATALOG).direction == "desc"
    assert tokens("a>=1 and b != \"x y\"") == ["a", ">=", "1", "and", "b", "!=", '"x y"']
    assert catalog_of("CREATE TABLE T (\n A INT PRIMARY KEY,\n b TEXT,\n FOREIGN KEY (b) REFERENCES u(a)\n);\n\nCREATE TABLE u (a REAL, d TEXT);") == {"t": ["a", "b"], "u": ["a", "d"]}
    assert Counter(classify(s, CATALOG)[0] for s in ["SELECT a FROM t;", "select a from t where a between 1 and 2"])["easy"] == 2


def test_name_keys(spark):
    spelled = ["synthetic_007", "Synthetic007", "synthetic_0007", "SYNTHETIC-7", " synthetic 07\t", "/srv/bases/synthetic_007.sqlite", r"D:\lots\synthétic_007.db "]
    assert set(_run(spark, spelled, name_key)) == {"synthetic7"}
    apart = ["db_1_2", "db_12", "db_1_02x", "db_120", "db_0", "db", "", None]
    assert _run(spark, apart, name_key) == ["db1_2", "db12", "db1_2x", "db120", "db0", "db", "", ""]
    assert _run(spark, ["synthetic_007", "Synthetic 07.sqlite", None], strict_name_key) == ["synthetic007", "synthetic07", ""]
