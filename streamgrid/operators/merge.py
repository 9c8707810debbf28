"""Merging streams in time order, completion, errors and failure streaks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.functions.scalars import rescale_ts
from streamgrid.operators.ordered import lag, ordered, running_sum
from streamgrid.schema import STREAM_KEYS

US_BASE = (1, 1_000_000)
STREAK = 5


def interleave(
    *streams: tuple[DataFrame, tuple[int, int]], time_base: tuple[int, int] = US_BASE, sort: bool = True
) -> DataFrame:
    """Bring packets of several streams to one time base and order them by (dts, stream_index, seq).

    Every stream is a pair of packets (session_id, seq, pts, dts) and their time base; ``stream_index`` is its
    position. The order is total, so the result does not depend on the partitioning. The sort is
    range-partitioned; leave it out (``sort=False``) when the result goes to ``write_merged`` or an aggregate.
    """
    rescaled = [
        df.withColumns({
            "stream_index": F.lit(i),
            **{tick: rescale_ts(tick, *base, *time_base) for tick in ("pts", "dts")},
        })
        for i, (df, base) in enumerate(streams)
    ]
    merged = functools.reduce(DataFrame.unionByName, rescaled)
    return merged.orderBy("dts", "stream_index", "seq") if sort else merged


def stream_completion(packets: DataFrame) -> DataFrame:
    """A session is complete when every stream has sent its end mark."""
    streams = packets.groupBy(*STREAM_KEYS).agg(
        F.count_if(F.col("kind") == "data").alias("packets"),
        F.max(F.when(F.col("kind") == "eof", 1).otherwise(0)).alias("ended"),
    )
    return (
        streams.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("streams"),
            F.sum("ended").cast("bigint").alias("ended"),
            F.sum("packets").alias("packets"),
        )
        .withColumn("complete", F.col("streams") == F.col("ended"))
    )


def first_error(errors: DataFrame, severity: Column) -> DataFrame:
    """The error that counts per session: lowest severity rank, then the earliest."""
    first = F.min(F.struct(severity.alias("severity"), "us", "seq", "stream_id", "kind"))
    return errors.groupBy("session_id").agg(first.alias("e"), F.count(F.lit(1)).alias("errors")).select(
        "session_id", "e.severity", "e.us", "e.seq", "e.stream_id", "e.kind", "errors"
    )


def warn_once(df: DataFrame, kind: str = "kind") -> DataFrame:
    """First occurrence per (stream, kind), as an aggregate, so a flood of one warning is combined map-side."""
    first = F.min(F.struct("us", "seq"))
    return df.groupBy(*STREAM_KEYS, kind).agg(first.alias("f"), F.count(F.lit(1)).alias("occurrences")).select(
        *STREAM_KEYS, kind, "f.us", "f.seq", "occurrences"
    )


def failure_streaks(
    df: DataFrame, failed: Column, min_length: int = STREAK, hot_rows: int | None = None
) -> DataFrame:
    """Runs of at least ``min_length`` consecutive failures; a success ends a run."""
    rows = ordered(df.withColumn("_failed", failed), STREAM_KEYS, ["us", "seq"], hot_rows=hot_rows)
    rows = rows.scan(_island=running_sum((~F.col("_failed")).cast("bigint"))).result()
    runs = rows.filter("_failed").groupBy(*STREAM_KEYS, "_island").agg(
        F.count(F.lit(1)).alias("failures"), F.min("us").alias("from_us"), F.max("us").alias("to_us")
    )
    return runs.filter(F.col("failures") >= min_length).drop("_island")


def merge_order_check(packets: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Per stream: steps back in dts along ``seq``, and rows whose pts precedes their dts."""
    rows = ordered(packets, STREAM_KEYS, ["seq"], hot_rows=hot_rows).scan(_previous=lag("dts")).result()
    return rows.groupBy(*STREAM_KEYS).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(F.col("dts") < F.col("_previous")).alias("dts_backward"),
        F.count_if(F.col("pts") < F.col("dts")).alias("pts_before_dts"),
        F.min("pts").alias("first_pts"),
        F.max("pts").alias("last_pts"),
    )
