"""Compare a query with its SQL: same columns, same rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value



def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple(repr(v) for v in r))


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def difference(df, db, sql: str) -> str | None:
    """None when equal, else what differs first."""
    cursor = db.execute(sql)
    want_names, want = table_rows([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            cells = [(n, x, y) for n, x, y in zip(got_names, a, b) if x != y]
            return f"{str(cells)[:600]} in {str(a)[:200]}"
    return None
