"""Every query with SQL gives the SQL's rows, and every query runs."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as driver
from basaltic.plans import catalogue
from tests.conftest import DATA

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (list, dict)) else v


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, base, name):
    df = catalogue.queries()[name](spark, DATA)
    found = base.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    rows = found.fetchall()
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(rows, columns)
    assert rows, "the query must not be vacuous"


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["canonical", "canonical_name", "count", "truncated"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
