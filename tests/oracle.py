"""Rows of a query against rows of its SQL."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(folder):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{folder}/{name}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)


def sql_rows(con, sql, columns):
    found = con.sql(sql)
    names = found.columns
    assert sorted(names) == columns
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
