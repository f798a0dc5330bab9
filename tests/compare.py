"""A query's rows against its SQL's in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, sql: str, con) -> list:
    """Empty if names, and rows in any order, are the same; else the first few rows of either side only."""
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    theirs = rows_of(theirs_names, cursor.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(theirs_names):
        return [("columns", sorted(df.columns), sorted(theirs_names))]
    if ours == theirs:
        return []
    a, b = set(ours), set(theirs)
    return [("rows", len(ours), len(theirs)), *[("spark", x) for x in sorted(a - b, key=str)[:4]], *[("duckdb", x) for x in sorted(b - a, key=str)[:4]], len(a - b)]
