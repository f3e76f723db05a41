"""Every query that SQL can express, against DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from waymark.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def same(spark_rows, columns, relation):
    order = sorted(columns)
    assert sorted(relation.columns) == order
    at = [relation.columns.index(c) for c in order]
    one = sorted((tuple(plain(r[c]) for c in order) for r in spark_rows), key=repr)
    two = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
    assert one == two


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    same(df.collect(), df.columns, duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
