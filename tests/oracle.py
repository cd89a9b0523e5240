"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd

DIR = os.environ.get("MOSSBROOK_TEST_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None) if v.tzinfo else v
    if isinstance(v, np.ndarray):
        v = v.tolist()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def duck(sql, directory=DIR):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c.execute(sql).df()
