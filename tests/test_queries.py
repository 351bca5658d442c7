"""Every query against its SQL, and those without SQL for a stable result, on the smallest tables."""

import os

import pytest

from conftest import DATA

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*SQL}))
def test_runs_twice_alike(spark, name):
    runs = [sorted(map(repr, QUERIES[name](spark, DATA).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
