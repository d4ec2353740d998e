"""Run registered queries against their checking SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, key: str, query, sql: str, folder: str) -> list[str]:
    """Differences between the two sides; empty when they agree."""
    df = query(spark, folder)
    got = canonical(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(names, cursor.fetchall())
    faults = []
    if sorted(df.columns) != sorted(names):
        return [f"{key}: columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        faults.append(f"{key}: {len(got)} rows != {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    if wrong:
        faults.append(f"{key}: {len(wrong)} rows differ, e.g.\n  {wrong[0][0]}\n  {wrong[0][1]}")
    types = [(n, type(a).__name__, type(b).__name__)
             for n, a, b in zip(sorted(names), got[0], want[0], strict=True)
             if a is not None and b is not None and type(a) is not type(b)] if got and want else []
    if types:
        faults.append(f"{key}: types {types}")
    return faults
