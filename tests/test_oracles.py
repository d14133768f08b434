"""Every query of the engine that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from lodestone.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple(repr(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)
    assert want
