"""Compare Spark results with DuckDB on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, types (by kind) and rows agree."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    types = {c: (got.schema.field(c).type, want.schema.field(c).type) for c in got.column_names}
    kinds = {c: t for c, t in types.items() if str(t[0]).replace("large_", "") != str(t[1]).replace("large_", "")}
    a = rows_of(got.column_names, [tuple(r.values()) for r in got.to_pylist()])
    b = rows_of(want.column_names, [tuple(r.values()) for r in want.to_pylist()])
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]} ({sorted(got.column_names)})"
    if kinds:
        return f"types {kinds}"
    return None
