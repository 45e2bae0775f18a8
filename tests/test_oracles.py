"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerfold import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_matches_sql(name, spark, duck):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.execute(plans.ORACLES[name]).df()
    (cols, a), (want_cols, b) = rows_of(got), rows_of(want)
    assert cols == want_cols
    number = lambda x: float(x) if x is not None and x.replace(".", "", 1).replace("-", "", 1).isdigit() else x
    assert [tuple(map(number, r)) for r in a] == [tuple(map(number, r)) for r in b]
