"""Runs a query in Spark and its SQL in DuckDB over the same Parquet tables and compares the rows."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(value: object) -> str:
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    return repr(value) if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """``None`` when both engines agree, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    want = rows_of(names, result.fetchall())
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows against {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
