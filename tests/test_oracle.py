"""Every query of the catalogue against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from quarry.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
        return None
    return tuple(plain(y) for y in x) if hasattr(x, "__len__") and not isinstance(x, (str, bytes)) else x


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].round(6).map(plain) if df[c].dtype.kind == "f" else df[c].map(plain)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    pd.testing.assert_frame_equal(normal(catalogue.queries()[name](spark, DATA).toPandas()), normal(con.sql(catalogue.oracle_sql()[name]).df()), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"sweep_metric_table", "tune_decision"}))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
