"""Compare a Spark result with a checking query run by DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb

from atlas.catalog.inputs import TABLES


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return "~nan" if value != value else repr(round(float(value), 9))
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(row[i]) for i in order) for row in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def check_rows(con, sql):
    cursor = con.execute(sql)
    return rows([c[0] for c in cursor.description], cursor.fetchall())
