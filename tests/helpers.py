"""Comparison of a query with its SQL on the small tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(folder: str = SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def assert_same(spark, query, sql: str, folder: str = SMALL) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    cursor = connection(folder).execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in at) for row in cursor.fetchall()), key=str)
    assert got == want
