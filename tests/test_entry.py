"""Registered queries run, and equal their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tickloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _rows(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in at) for r in rows), key=str)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["symbol", "time", "sma_value"] and df.count() > 0


def test_sql_names():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(catalog.QUERIES) >= 90


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, data, duck, name):
    got = entry_points.queries()[name](spark, data)
    want = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())
