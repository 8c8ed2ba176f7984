"""Every query with SQL gives the SQL's rows."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sievelight import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet({glob.glob(f'{DATA}/{t}.parquet') or [f'{DATA}/{t}.parquet/*']})")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not isinstance(v, pd.Timestamp):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(plain, v))
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    return sorted(map(repr, ([plain(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalogue.SQL:
        expected = duck.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).columns == ["email_id", "verdict", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
