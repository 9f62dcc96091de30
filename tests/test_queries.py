"""Every query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from palisade.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def rows(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "-"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{x:.5f}"
        return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql())
