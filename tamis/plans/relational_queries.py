"""The relational operators of the SQL dialect (G2-G20), as SQL that Spark and the check read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.metrics import ranked
from tamis.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings d_retry_corrected batch_responses request_meta db_catalogue seed_plan heldout_items sample_targets run_params".split()


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables of a directory; only the tables it names are opened."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


_SQL = {
    "g02_table_aliases": "SELECT T1.c_name AS customer, T2.n_name AS nation FROM customer AS T1 JOIN nation AS T2 ON T1.c_nationkey = T2.n_nationkey WHERE T1.c_acctbal > 9000",
    "g04_aggregates": "SELECT max(l_quantity) AS max_q, min(l_quantity) AS min_q, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_q, round(avg(l_quantity), 6) AS avg_q FROM lineitem",
    "g05_column_arithmetic": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS saved, l_quantity + l_linenumber AS plus_line, l_quantity - l_linenumber AS minus_line FROM lineitem WHERE l_quantity / 2 > 24.5",
    "g06_select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "g07_join_chain": "SELECT r_name, count(*) AS orders_placed, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "g07_join_inequality": "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "g07_bare_join": "SELECT r_name, count(*) AS pairs FROM region JOIN nation ON 1 = 1 GROUP BY r_name",
    "g08_subquery_in_from": "SELECT c_mktsegment, round(avg(n), 6) AS mean_orders FROM (SELECT c_custkey, c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment) t GROUP BY c_mktsegment",
    "g09_flat_and_or": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderstatus = 'P' AND NOT o_totalprice > 150000",
    "g10_comparisons": "SELECT CAST(count_if(l_quantity = 10) AS BIGINT) AS eq, CAST(count_if(l_quantity > 10) AS BIGINT) AS gt, CAST(count_if(l_quantity < 10) AS BIGINT) AS lt, CAST(count_if(l_quantity >= 10) AS BIGINT) AS ge, CAST(count_if(l_quantity <= 10) AS BIGINT) AS le, CAST(count_if(l_quantity != 10) AS BIGINT) AS ne FROM lineitem",
    "g11_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31' AND l_quantity BETWEEN 10 AND 12",
    "g12_like": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%e%' AND NOT p_type ILIKE '%brass%'",
    "g13_in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "g13_not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IS NOT NULL)",
    "g14_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "g15_literals": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000.5 AND o_orderpriority = '1-URGENT' AND o_custkey = o_custkey",
    "g16_group_by": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus",
    "g16_bare_column": "SELECT o_custkey, min(o_orderstatus) AS any_status, count(*) AS n FROM orders GROUP BY o_custkey",
    "g17_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590 OR sum(CAST(l_quantity AS BIGINT)) < 12000",
    "g18_order_by": "SELECT s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS place FROM supplier ORDER BY s_acctbal DESC, s_name",
    "g19_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "g20_intersect": "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "g20_union": "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "g20_except": "SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "g_pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "g_exists": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "g_with_case_window": "WITH t AS (SELECT c_nationkey, c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer) SELECT c_nationkey, c_custkey, side FROM t WHERE r <= 3",
    "g_left_join_is_null": "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 WHERE o_orderkey IS NULL",
}


def _query(sql: str):
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


def _order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted rows with their places, numbered without one task for all rows."""
    d = table(spark, sf_dir, "supplier").select("s_name", "s_acctbal")
    return ranked(d, [-F.col("s_acctbal"), F.col("s_name")]).withColumnRenamed("position", "place").orderBy("place")


QUERIES = {name: _query(sql) for name, sql in _SQL.items()} | {"g18_order_by": _order_by}
ORACLE = dict(_SQL)
