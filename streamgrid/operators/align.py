"""Aligning streams with each other: as-of state, extents, missing and shared slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.operators.ordered import Ordered, last_value, ordered


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    value: str = "value",
    key: str = "session_id",
    hot_rows: int | None = None,
    rows_bound: int | None = None,
) -> DataFrame:
    """At every update of either side, the latest known value of both.

    Updates at the same time are ordered left before right, then by ``seq``. ``rows_bound`` is a known bound of
    the updates per key; it spares counting them, which matters when the sides are costly to compute.
    """
    return asof_scan(left, right, value, key, hot_rows, rows_bound).result()


def asof_scan(
    left: DataFrame, right: DataFrame, value: str, key: str, hot_rows: int | None = None, rows_bound: int | None = None
) -> Ordered:
    """The ordered frame behind ``asof_latest``, for callers that go on scanning in the same order."""

    def side(df: DataFrame, number: int) -> DataFrame:
        null = F.lit(None).cast(df.schema[value].dataType)
        own, other = ("left_value", "right_value") if number == 0 else ("right_value", "left_value")
        columns = {own: F.col(value).alias(own), other: null.alias(other)}
        return df.select(key, "us", F.lit(number).alias("side"), "seq", columns["left_value"], columns["right_value"])

    both = side(left, 0).unionByName(side(right, 1))
    rows = ordered(both, [key], ["us", "side", "seq"], hot_rows=hot_rows, rows_bound=rows_bound)
    return rows.scan(latest_left=last_value("left_value"), latest_right=last_value("right_value"))


def stream_extents(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "stream_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def compare_extents(extents: DataFrame, tol_start_us: int, tol_len_us: int) -> DataFrame:
    """Do all streams of a session start together and last equally long?

    Every pair agrees exactly when the largest and the smallest value agree, so no pairs are formed.
    """
    length = F.col("end_us") - F.col("start_us")
    spread = extents.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("streams"),
        (F.max("start_us") - F.min("start_us")).alias("start_gap_us"),
        (F.max(length) - F.min(length)).alias("length_gap_us"),
    )
    return spread.withColumn("starts_agree", F.col("start_gap_us") < tol_start_us).withColumn(
        "lengths_agree", F.col("length_gap_us") < tol_len_us
    )


def missing_slots(slots: DataFrame, of: str, absent_in: str) -> DataFrame:
    """Slots of stream ``of`` that stream ``absent_in`` does not have (slots are unique per stream)."""
    return _compare(slots, of, absent_in, "left_anti")


def shared_slots(slots: DataFrame, first: str, second: str) -> DataFrame:
    return _compare(slots, first, second, "left_semi")


def _compare(slots: DataFrame, first: str, second: str, how: str) -> DataFrame:
    left = slots.filter(F.col("stream_id") == first)
    right = slots.filter(F.col("stream_id") == second).select("session_id", "slot")
    return left.join(right, ["session_id", "slot"], how)


def covered_period(extents: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The period all streams of a session cover."""
    start, end = F.max("start_us"), F.min("end_us")
    return extents.groupBy(*by).agg(start.alias("from_us"), end.alias("to_us"))


def within(us: Column, first: Column, last: Column) -> Column:
    return (us >= first) & (us <= last)
