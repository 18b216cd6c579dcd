"""Comparison of a query with its SQL run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if hasattr(x, "isoformat"):
        return str(x)[:26]
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    return str(x)


def connection(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted([_plain(r[c]) for c in cols] for r in df.collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    cols = sorted(names)
    return cols, sorted([_plain(r[names.index(c)]) for c in cols] for r in found.fetchall())
