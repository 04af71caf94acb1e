"""The entry point, and all base queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from platewise.plans import registry as base

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(base.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = base.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = [plain(tuple(r)) for r in df.select(*cols).collect()]
    run = duck.execute(base.ORACLE_SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    want = [plain(tuple(r[names.index(c)] for c in cols)) for r in run.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert base.QUERIES[name](spark, FOLDER).count() > 0
