"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from placekeep import catalogue

DATA = Path(os.environ.get("PLACEKEEP_TEST_DATA", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA / t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
