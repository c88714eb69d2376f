"""Every registered query against its SQL on the smallest data, where that is there."""

import os

import duckdb
import pytest

from tamis.plans.catalog import collect

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = collect()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(want.columns, want.fetchall())
