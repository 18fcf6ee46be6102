"""Small fixtures for the operators of the training-data pipeline."""

import os

import duckdb
import pandas as pd
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Make a documents table of (doc_id, text) rows, with a clashing extra column."""

    def make(rows, source=lambda i: f"src{(i or 0) % 3}"):
        full = [(i, t, "en", source(i), None if t is None else len(t), "extra", 7) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", task string, rank int")

    return make


@pytest.fixture
def same():
    """Compare a DataFrame with DuckDB's result over the tables of a folder."""

    def check(df, sql, sf=SF, tables=("documents", "labels", "conversations", "embeddings")):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in tables:
            at = f"{sf}/{t}.parquet"
            at += "/*.parquet" if os.path.isdir(at) else ""
            con.execute(f"create view {t} as select * from '{at}'")
        want, got = con.execute(sql).df(), df.toPandas()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        want, got = (x[cols].sort_values(cols[:]).reset_index(drop=True) for x in (want, got))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)

    return check
