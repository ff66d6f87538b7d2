"""Every query of the subpackage that has SQL gives the same rows in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from kelpwood.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(str(norm(tuple(r))) for r in df.select(*columns).collect())
    want = sorted(str(norm(r)) for r in duck.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall())
    assert got == want
