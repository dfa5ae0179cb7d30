"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb

DATA = "/root/testdata"


def normal(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    return value


def rows(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(normal(r[i]) for i in order)) for r in cursor.fetchall())
