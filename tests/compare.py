"""Compares a query with its SQL answer, row by row, after sorting."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value) if isinstance(value, decimal.Decimal) else value
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql) -> list[str]:
    """Empty when both give the same columns and rows."""
    names, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    sql_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != sql_names:
        return [f"columns {sorted(set(names) ^ set(sql_names))}"]
    found = [] if len(ours) == len(theirs) else [f"{len(ours)} rows against {len(theirs)}"]
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    for a, b in bad[:3]:
        found.append("; ".join(f"{n}: {x!r} != {y!r}" for n, x, y in zip(names, a, b) if x != y))
    return found + ([f"{len(bad)} rows differ"] if bad else [])
