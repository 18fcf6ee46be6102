"""Every query equals its SQL over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from moraine.plans import oracle, queries

SF = "/root/testdata/sf0.001"
SQL = oracle.build()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        at = f"{SF}/{t}" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}") else "")
        con.execute(f"create view {t.split('.')[0]} as select * from '{at}'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0
        return
    want = duck.execute(SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    rows = lambda df: sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def norm(v):
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
