"""Queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

from palisade.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    shaped = lambda df: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].astype(object).values.tolist())
    assert shaped(got) == shaped(want)
