"""Rows of a query against its SQL in DuckDB, independent of order."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    got = connect(folder).execute(sql)
    return mine == canonical([x[0] for x in got.description], got.fetchall())
