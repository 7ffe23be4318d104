"""Every registered query with SQL gives the same rows in DuckDB; every other one gives rows or an empty result."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sheaf.plans.fixtures import TABLES
from sheaf.plans.registry import registered, registered_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    def one(v):
        if v is None or (np.isscalar(v) or v is pd.NA or v is pd.NaT) and pd.isna(v):
            return "NULL"
        return f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, duck, name):
    got = registered()[name](spark, SF).toPandas()
    sql = registered_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
