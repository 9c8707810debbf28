"""Joining a large table with a per-session or per-stream lookup that has one row per key."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamgrid.sources.sinks import scratch_path

BROADCAST_ROWS = 200_000
#: What a lookup may weigh on the driver and in a broadcast; wide rows lower the number of rows.
BROADCAST_BYTES = 32 * 1024**2
SALTS = 64


class Bounded(NamedTuple):
    """A small aggregate, evaluated once and held as a local table; a larger one is written and read from there."""

    df: DataFrame
    table: pa.Table | None

    @property
    def is_local(self) -> bool:
        return self.table is not None


def _row_bytes(df: DataFrame) -> int:
    """Estimated width of a row: eight bytes for a number or a time, sixty-four for anything else."""
    narrow = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return sum(8 if isinstance(f.dataType, narrow) else 64 for f in df.schema)


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> Bounded:
    """Evaluate ``df`` on the driver unless it has more than ``max_rows`` rows or ``BROADCAST_BYTES``.

    At most one row more is fetched to find out. A larger one is written to the shared folder, once for all its uses.
    """
    most = max(1, min(max_rows, BROADCAST_BYTES // max(1, _row_bytes(df))))
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most or table.nbytes > 2 * BROADCAST_BYTES:
        path = scratch_path(df.sparkSession, "lookup")
        df.write.parquet(path)
        return Bounded(df.sparkSession.read.schema(df.schema).parquet(path), None)
    local = df.sparkSession.createDataFrame(table, schema=df.schema) if table.num_rows else df.limit(0)
    return Bounded(local, table)


def lookup_join(
    big: DataFrame,
    lookup: DataFrame | Bounded,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join on ``on`` (inner or left), at most one lookup row per key.

    The lookup is an aggregate whose row count grows with the number of keys. It is evaluated once. A single
    row becomes literals; while it has at most ``max_rows`` rows and ``BROADCAST_BYTES`` it is broadcast, so the large side is not
    shuffled at all. A larger lookup is joined by a shuffle, each lookup row repeated ``salts`` times and the
    large side spread over the salts by a hash of ``spread_by``, so one hot key is spread over many tasks.
    """
    small = lookup if isinstance(lookup, Bounded) else bounded(lookup, max_rows)
    if small.is_local and small.table.num_rows == 1:
        return _literal_join(big, small, list(on), how)
    if small.is_local:
        return big.join(F.broadcast(small.df), list(on), how)
    if not spread_by:
        return big.join(small.df, list(on), how)
    salted = small.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


def _literal_join(big: DataFrame, small: Bounded, on: list[str], how: str) -> DataFrame:
    row = small.table.to_pylist()[0]
    same = functools.reduce(lambda a, b: a & b, [F.col(k) == _literal(small, row, k) for k in on])
    added = [c for c in small.df.columns if c not in on]
    if how == "inner":
        return big.filter(same).withColumns({c: _literal(small, row, c) for c in added})
    return big.withColumns({c: F.when(same, _literal(small, row, c)) for c in added})


def _literal(small: Bounded, row: dict, name: str) -> Column:
    return F.lit(row[name]).cast(small.df.schema[name].dataType)
