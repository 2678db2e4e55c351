"""The query registry: every query runs, and SQL agrees where there is some."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldcube import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x) + 0.0:.6f}"
    return str(x.replace(tzinfo=None)) if hasattr(x, "hour") else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    found = got.collect()
    if name in queries.ORACLE_SQL:
        expected = duck.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in expected.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, found) == rows(columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
