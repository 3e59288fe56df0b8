"""Compares a Spark result with DuckDB's for the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    return repr(float(v) + 0.0) if isinstance(v, int | float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted("|".join(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def assert_same(df, con, sql):
    assert rows(df.toPandas()) == rows(con.execute(sql).fetchdf())
