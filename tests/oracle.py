"""Compares a query with its SQL, value by value."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(x) -> str:
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}"
    if hasattr(x, "as_tuple"):  # a decimal
        return f"{float(x):.6f}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(norm, x)) + "]"
    return str(x)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(norm(row[i]) for i in at) for row in cursor.fetchall())
