"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares the rows."""

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder=DATA):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def difference(spark_rows, names, con, sql):
    """Rows that only one side has."""
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    a = Counter(repr(tuple(plain(r[c]) for c in order)) for r in spark_rows)
    at = [found.columns.index(c) for c in order]
    b = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    return list((a - b).elements())[:3], list((b - a).elements())[:3]
