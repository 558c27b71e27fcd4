"""Rows of a Spark result and of a DuckDB query in one comparable form."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (int, float)):
        return round(float(v), 8) + 0.0
    return v


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert ours == theirs
