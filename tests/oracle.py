"""Comparing a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

TABLES_AT = os.environ.get("TESTDATA", "/root/testdata")


def connect(d: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{d}/*.parquet")):
        name, source = os.path.basename(path)[:-8], f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def duck_rows(con, sql: str):
    con.execute(sql)
    columns = [x[0] for x in con.description]
    return sorted(columns), rows_of(columns, con.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def compare(spark, con, d: str, query, sql: str) -> str:
    """Empty if the results agree, else what differs."""
    ours, theirs = spark_rows(query(spark, d)), duck_rows(con, sql)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] == theirs[1]:
        return ""
    a, b = set(ours[1]), set(theirs[1])
    return f"{len(ours[1])} and {len(theirs[1])} rows; only here {sorted(a - b, key=repr)[:3]}; only there {sorted(b - a, key=repr)[:3]}"
