"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Rows with their columns by name, in a total order, numbers to nine digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}") if isinstance(v, (float, Decimal)) else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, rows_of(names, found.fetchall())


def spark_rows(df) -> list[tuple]:
    return rows_of(df.columns, df.collect())
