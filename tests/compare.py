"""Rows of a Spark query and of its SQL in DuckDB, in one comparable form."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal, np.floating)):
        return None if value != value else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    return columns, Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
