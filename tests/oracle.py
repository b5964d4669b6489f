"""Runs a query and its SQL, and compares rows without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, float):
        return round(v, 8)
    return v


def key(row):
    return tuple(("", "") if x is None else (type(x).__name__ if not isinstance(x, (int, float)) else "n", x) for x in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
