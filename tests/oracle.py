"""Compares a query's rows with its SQL's, whatever their order."""

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | np.ndarray):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating | decimal.Decimal):
        return round(float(v), 8)
    if isinstance(v, pd.Timestamp | datetime.datetime | np.datetime64):
        t = pd.Timestamp(v)
        return str(t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t)
    return str(v)


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def expected(sql, folder):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.execute(sql).df()


def agree(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
