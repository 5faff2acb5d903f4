"""Comparison of queries with their SQL, value by value."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "" if pd.isna(v) else str(round(v, 6) + 0.0)
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([_plain(x) for x in v])
    return "" if v is None or v is pd.NaT or v is pd.NA else str(round(float(v), 6) + 0.0) if isinstance(v, (int,)) and not isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def assert_same(mine, theirs):
    a, b = rows(mine), rows(theirs)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1], next((x, y) for x, y in zip(a[1], b[1]) if x != y)
