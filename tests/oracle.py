"""Compares a query with its SQL in DuckDB over the same tables: columns by name, rows in any order, doubles to 9 digits."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    return value


def rows_of(columns: list[str], rows: list) -> list[str]:
    by = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([_plain(r[k]) for k in by]) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, shortly; None if nothing does."""
    cursor = con.cursor()
    told = cursor.execute(sql)
    names = [d[0] for d in told.description]
    want = rows_of(names, told.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    if got == want:
        return None
    left, right = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; only here {sorted(left)[:3]}; only there {sorted(right)[:3]}"
