"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from trialkit.plans.oracles import oracles
from trialkit.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float)) else str(value)


def rows_of(columns, names, rows):
    spots = [names.index(c) for c in columns]
    out = [tuple(plain(r[i]) for i in spots) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(oracles())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    found = duck.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    got = rows_of(columns, df.columns, df.collect())
    assert got == rows_of(columns, found.columns, found.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
