"""Holds a Spark result against DuckDB's over the same tables: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(cell(r[k]) for k in at) for r in cur.fetchall()), key=repr)
