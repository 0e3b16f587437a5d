"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from orrery.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, (bool, np.bool_)) or not hasattr(x, "__float__") or isinstance(x, str):
        return str(x)
    return f"{float(x):.6g}"


def rows(d):
    return sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, con):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
