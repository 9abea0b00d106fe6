"""Comparison of a query's rows with DuckDB's on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for n in TABLES:
        p = f"{folder}/{n}.parquet"
        con.sql(f"create view {n} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    frame = con.sql(sql).df()
    return _rows(frame), sorted(frame.columns)


def _rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(map(_text, r)) for r in frame[cols].itertuples(index=False))


def _text(v):
    """A value as text; pandas makes whole numbers with nulls beside them floats, in one frame and not in the other."""
    if v is None or v is pd.NA or v != v:
        return ""
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else str(v)


def spark_rows(df):
    frame = df.toPandas()
    return _rows(frame), sorted(frame.columns)
