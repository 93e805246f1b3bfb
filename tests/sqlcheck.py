"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def plain(x):
    try:
        if x is None or x != x:
            return ""
    except (TypeError, ValueError):
        pass
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.9g}"
    except (TypeError, ValueError):
        return str(x)


def same(df, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    ours, theirs = df.toPandas(), con.sql(sql).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    a, b = (sorted(tuple(map(plain, r)) for r in x[cols].astype(object).values.tolist()) for x in (ours, theirs))
    assert a == b
    return len(a)
