"""Every registered engine query against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from conftest import SF
from millrace.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return "NULL"
    try:
        f = float(v)
        return "nan" if math.isnan(f) else repr(f)
    except (TypeError, ValueError):
        return str(v).removesuffix(" 00:00:00")


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
