"""Runs a query and its SQL twin over the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differ(spark, con, run, sql, sf_dir):
    """None, or what differs."""
    df = run(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a, b = ([tuple(plain(r[i]) for i in sorted(range(len(n)), key=n.__getitem__)) for r in data] for n, data in ((df.columns, df.collect()), (names, cur.fetchall())))
    a, b = sorted(a, key=key), sorted(b, key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
