"""Compare queries with their SQL in DuckDB: columns, rows and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb


def connection(root: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(root)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{root}/{f}'")
    return c


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0 if v else 0.0
    return v


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same."""
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(names, result.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return f"{len(have)} rows, SQL {len(want)}"
    off = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(off)} of {len(want)} rows differ, such as {off[0][0]} and {off[0][1]}" if off else ""
