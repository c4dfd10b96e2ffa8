"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pagewright import queries as core

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
    return df.astype(str).replace({"None": "-", "nan": "-", "<NA>": "-"}).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, DIR).toPandas(), duck.execute(core.ORACLE[name]).fetch_df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_stream_equals_batch(spark):
    batch = core.QUERIES["watermark_sessions"](spark, DIR).toPandas()
    stream = core.QUERIES["session_stream"](spark, DIR).toPandas()
    assert plain(batch).equals(plain(stream[list(batch.columns)]))


def test_other_queries_have_rows(spark):
    for name in set(core.QUERIES) - set(core.ORACLE) - {"session_stream"}:
        assert core.QUERIES[name](spark, DIR).count() > 0


def test_entry_lists_core_queries():
    import __spark_entry__ as e

    assert set(core.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
