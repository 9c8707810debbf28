"""Watermarks, tumbling metrics, session segments and duplicate thinning with built-in operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.schema import STREAM_KEYS


def with_lookahead(df: DataFrame, lookahead: str, ts: str = "ts") -> DataFrame:
    """Watermark on event time; the lookahead has to exceed the delivery latency of the source."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lookahead)


def tick_counters(df: DataFrame, tick: str, counters: Mapping[str, Column]) -> DataFrame:
    """Counters per stream and tick, combined before the shuffle; a tick is final once the watermark passed it."""
    return (
        df.groupBy(*STREAM_KEYS, F.window("ts", tick).alias("w"))
        .agg(*[F.sum(c.cast("bigint")).alias(name) for name, c in counters.items()])
        .select(*STREAM_KEYS, F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("to_us"), *counters)
    )


def configure_sessions(spark: SparkSession) -> None:
    """Merge session windows inside each map task first, so a hot stream sends sessions instead of rows."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def gap_sessions(df: DataFrame, gap: str) -> DataFrame:
    """Segments of a stream that end when no row follows within ``gap``."""
    configure_sessions(df.sparkSession)
    return (
        df.groupBy(*STREAM_KEYS, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("us").alias("from_us"), F.max("us").alias("to_us"))
        .select(*STREAM_KEYS, "rows", "from_us", "to_us")
    )


def thin_duplicates(df: DataFrame, tick_us: int = 1) -> DataFrame:
    """One row per (stream, tick) within the watermark."""
    ticks = df.withColumn("tick", F.floor(F.col("us") / tick_us))
    return ticks.dropDuplicatesWithinWatermark([*STREAM_KEYS, "tick"])
