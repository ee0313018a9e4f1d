"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(names: list[str], rows: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a query's rows and its SQL's, or None."""
    found = con.execute(sql)
    want_names = [d[0] for d in found.description]
    want = rows_of(want_names, found.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} and {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {sorted(set(got) - set(want), key=repr)[:2]} {sorted(set(want) - set(got), key=repr)[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w and not all(a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)) for a, b in zip(g, w))]
    exact = sum(g != w for g, w in zip(got, want))
    return f"{len(bad)} of {len(got)} rows, {bad[:2]}" if bad else f"{exact} rows differ in rounding" if exact else None
