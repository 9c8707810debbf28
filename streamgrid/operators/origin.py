"""Common origin of the streams of a session, and trimming of what lies before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamgrid.operators.joins import Bounded, lookup_join
from streamgrid.schema import STREAM_KEYS


def stream_firsts(df: DataFrame) -> DataFrame:
    return df.groupBy(*STREAM_KEYS).agg(F.min("us").alias("first_us"))


def common_origin(df: DataFrame, withdrawn: DataFrame | None = None, timeout_us: int | None = None) -> DataFrame:
    """``t0 = max(first event time per stream)`` per session.

    ``withdrawn`` lists (session_id, stream_id) that do not take part. With ``timeout_us`` only streams that
    start within the timeout after the earliest one decide; later streams receive the resolved origin.
    """
    firsts = stream_firsts(df)
    if withdrawn is not None:
        firsts = firsts.join(withdrawn.select(*STREAM_KEYS).distinct(), list(STREAM_KEYS), "left_anti")
    if timeout_us is not None:
        earliest = firsts.groupBy("session_id").agg(F.min("first_us").alias("earliest_us"))
        firsts = lookup_join(firsts, earliest, ["session_id"], spread_by=["stream_id"]).filter(
            F.col("first_us") <= F.col("earliest_us") + F.lit(timeout_us)
        )
    return firsts.groupBy("session_id").agg(F.max("first_us").alias("t0"), F.count(F.lit(1)).alias("streams"))


def session_bounds(df: DataFrame, by_arrival: bool = False) -> DataFrame:
    """Common origin and last event time per session, in one pass; ``by_arrival`` adds the last arrival."""
    last = {"end_us": "us", **({"end_arrival_us": "arrival_us"} if by_arrival else {})}
    ends = [F.max(c).alias(name) for name, c in last.items()]
    streams = df.groupBy(*STREAM_KEYS).agg(F.min("us").alias("first_us"), *ends)
    return streams.groupBy("session_id").agg(F.max("first_us").alias("t0"), *[F.max(name).alias(name) for name in last])


def attach_origin(df: DataFrame, origin: DataFrame | Bounded, how: str = "inner") -> DataFrame:
    """Give every row its session's ``t0``; with ``how="left"`` rows whose session has none stay, without."""
    if not isinstance(origin, Bounded):
        origin = origin.select("session_id", "t0")
    return lookup_join(df, origin, ["session_id"], how, spread_by=["stream_id", "seq"])


def trim_pre_origin(df: DataFrame) -> DataFrame:
    return df.filter(F.col("us") >= F.col("t0"))


def pre_origin_counts(df: DataFrame) -> DataFrame:
    """Rows kept and discarded by the trim, per stream."""
    early = F.col("us") < F.col("t0")
    return df.groupBy(*STREAM_KEYS).agg(
        F.count_if(early).alias("pre_origin"),
        F.count_if(~early).alias("kept"),
    )
