"""Ordered scans (running sum, lag, last value ...) per stream that do not put a whole stream into one task.

A plain window over a stream key is one task per stream, which fails once a stream holds a large share of
the rows. Here every stream is cut into *parts* along its order, and a scan runs in two levels:

1. one summary row per (stream, part), a hash aggregate with map-side combine;
2. a window over those summaries gives the value carried into each part;
3. a window inside each (stream, part), combined with the carried value.

Parts come from a cheap bounded expression when there is one (slots are unique per stream, so ``slot div n``
holds at most n rows). Otherwise the rows per stream are counted first: while the largest stream fits into one
task there is a single part and a plain window; beyond that the rows are range-partitioned on
(stream, order) - Spark's own skew-proof split - and written to the shared scratch folder, so that both levels
see the same cut and the summary level reads only the columns it needs.
A caller that knows a bound on the rows per stream spares the count.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamgrid.sources.sinks import scratch_path

HOT_ROWS = 4_000_000
#: A cut is a task and a file. Where ``hot_rows`` asks for more than ``LEAST_CUTS``, a part has so many rows on average.
PART_ROWS = 100_000
LEAST_CUTS = 64
PART = "_part"


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None
    inclusive: bool = True


def running_sum(value: Column | str, inclusive: bool = True) -> Scan:
    return Scan("sum", _as_col(value), inclusive)


def running_max(value: Column | str, inclusive: bool = True) -> Scan:
    return Scan("max", _as_col(value), inclusive)


def last_value(value: Column | str, inclusive: bool = True) -> Scan:
    """Latest non-null value so far."""
    return Scan("last", _as_col(value), inclusive)


def first_value(value: Column | str) -> Scan:
    """First non-null value so far."""
    return Scan("first", _as_col(value))


def lag(value: Column | str) -> Scan:
    return Scan("lag", _as_col(value))


def lead(value: Column | str) -> Scan:
    return Scan("lead", _as_col(value))


def row_number() -> Scan:
    return Scan("row_number")


def _as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Ordered:
    """A DataFrame with stream keys, a total order and a part column (absent while one part is enough)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], split: bool):
        self._df = df
        self.keys = list(keys)
        self.order = list(order)
        self.split = split

    def with_columns(self, **columns: Column) -> Ordered:
        return Ordered(self._df.withColumns(columns), self.keys, self.order, self.split)

    def result(self) -> DataFrame:
        return self._df.drop(PART)

    def parted(self) -> DataFrame:
        """The rows with their part column, for operators that fold parts themselves."""
        return self._df if self.split else self._df.withColumn(PART, F.lit(0).cast("bigint"))

    def scan(self, **scans: Scan) -> Ordered:
        inputs = {f"_in_{name}": s.value for name, s in scans.items() if s.value is not None}
        df = self._df.withColumns(inputs) if inputs else self._df
        if self.split:
            df = df.join(self._carry(df, scans), [*self.keys, PART], "left")
        window_keys = [*self.keys, PART] if self.split else self.keys
        window = W.partitionBy(*window_keys).orderBy(*self.order)
        df = df.withColumns({name: self._local(name, s, window) for name, s in scans.items()})
        return Ordered(df.drop(*inputs, *(f"_carry_{n}" for n in scans)), self.keys, self.order, self.split)

    def _carry(self, df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        summaries = []
        for name, s in scans.items():
            col = F.col(f"_in_{name}")
            summary = {
                "sum": lambda: F.sum(col),
                "max": lambda: F.max(col),
                "last": lambda: self._edge(col, col.isNotNull(), latest=True),
                "first": lambda: self._edge(col, col.isNotNull(), latest=False),
                "lag": lambda: F.struct(self._edge(col, F.lit(True), latest=True).alias("v")),
                "lead": lambda: F.struct(self._edge(col, F.lit(True), latest=False).alias("v")),
                "row_number": lambda: F.count(F.lit(1)),
            }[s.kind]()
            summaries.append(summary.alias(f"_carry_{name}"))
        parts = W.partitionBy(*self.keys).orderBy(PART)
        before = parts.rowsBetween(W.unboundedPreceding, -1)
        carried = []
        for name, s in scans.items():
            col = F.col(f"_carry_{name}")
            carried.append({
                "sum": lambda: F.sum(col).over(before),
                "max": lambda: F.max(col).over(before),
                "last": lambda: F.last(col, ignorenulls=True).over(before),
                "first": lambda: F.first(col, ignorenulls=True).over(before),
                "lag": lambda: F.lag(col).over(parts),
                "lead": lambda: F.lead(col).over(parts),
                "row_number": lambda: F.sum(col).over(before),
            }[s.kind]().alias(f"_carry_{name}"))
        return df.groupBy(*self.keys, PART).agg(*summaries).select(*self.keys, PART, *carried)

    def _edge(self, col: Column, eligible: Column, latest: bool) -> Column:
        """Value of the last or first eligible row. Primitive order columns keep it a hash aggregate."""
        if len(self.order) == 1:
            rank = F.when(eligible, F.col(self.order[0]))
            return F.max_by(col, rank) if latest else F.min_by(col, rank)
        row = F.when(eligible, F.struct(*self.order, col.alias("_v")))
        return (F.max(row) if latest else F.min(row))["_v"]

    def _local(self, name: str, s: Scan, window: W) -> Column:
        col = F.col(f"_in_{name}") if s.value is not None else None
        frame = window.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1)
        carry = F.col(f"_carry_{name}") if self.split else None
        if s.kind == "sum":
            local = F.coalesce(F.sum(col).over(frame), F.lit(0))
            return local if carry is None else local + F.coalesce(carry, F.lit(0))
        if s.kind == "max":
            local = F.max(col).over(frame)
            return local if carry is None else F.greatest(local, carry)
        if s.kind == "last":
            local = F.last(col, ignorenulls=True).over(frame)
            return local if carry is None else F.coalesce(local, carry)
        if s.kind == "first":
            local = F.first(col, ignorenulls=True).over(frame)
            return local if carry is None else F.coalesce(carry, local)
        if s.kind == "row_number":
            local = F.row_number().over(window).cast("bigint")
            return local if carry is None else local + F.coalesce(carry, F.lit(0))
        shift = F.lag if s.kind == "lag" else F.lead
        if carry is None:
            return shift(col).over(window)
        # The neighbour may be null itself, so its presence is told by the wrapping struct.
        return F.coalesce(shift(F.struct(col.alias("v"))).over(window), carry)["v"]


def refuse_null(keys: Sequence[str]) -> dict[str, Column]:
    message = F.lit(f"stream keys {list(keys)} must not be null; see split_malformed")
    return {k: F.coalesce(F.col(k), F.raise_error(message)) for k in keys}


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    part: Column | None = None,
    hot_rows: int | None = None,
    rows_bound: int | None = None,
) -> Ordered:
    """Prepare ordered scans. ``order`` must be total per stream; stream keys must not be null.

    ``rows_bound`` is an upper bound of the rows per stream (the total number of rows if nothing better is
    known): up to ``hot_rows`` one part is enough. ``part`` is a bounded, order-preserving part number. With
    neither, the rows per stream are counted by one aggregate over the key columns. ``hot_rows`` says from which size
    on streams are cut, into parts of half of it; a low one does not make parts too small to be worth a task.
    """
    hot_rows = hot_rows or HOT_ROWS
    if rows_bound is not None and rows_bound <= hot_rows:
        return Ordered(df.withColumns(refuse_null(keys)), keys, order, split=False)
    if part is not None:
        return Ordered(df.withColumns({**refuse_null(keys), PART: part.cast("bigint")}), keys, order, split=True)
    if rows_bound is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        has_null = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        rows_bound, peak, nulls = sizes.agg(F.sum("n"), F.max("n"), F.max(has_null)).first()
        if nulls:
            raise ValueError(f"stream keys {list(keys)} must not be null; see split_malformed")
        if (peak or 0) <= hot_rows:
            return Ordered(df, keys, order, split=False)
    cuts = cuts_for(rows_bound, hot_rows)
    ranged = df.withColumns(refuse_null(keys)).repartitionByRange(cuts, *keys, *order)
    ranged = ranged.withColumn(PART, F.spark_partition_id().cast("bigint"))
    path = scratch_path(df.sparkSession, "ordered")
    ranged.write.parquet(path)
    return Ordered(df.sparkSession.read.schema(ranged.schema).parquet(path), keys, order, split=True)


def cuts_for(total: int, hot_rows: int) -> int:
    """How many parts ``total`` rows are cut into: each costs a task, a file and its share of the sampled bounds."""
    return min(math.ceil(total / max(1, hot_rows // 2)), max(LEAST_CUTS, math.ceil(total / PART_ROWS)))


def span_bound(df: DataFrame, us: str, period_us: int) -> int:
    """Upper bound of the distinct periods a stream can touch, from the time range of all rows."""
    low, high = df.agg(F.min(us), F.max(us)).first()
    return 0 if low is None else (high - low) // period_us + 2
