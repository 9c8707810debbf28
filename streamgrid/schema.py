"""Canonical schemas. Times are BIGINT microseconds (``us``) next to the original TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import types as T

STREAM_KEYS = ("session_id", "stream_id")

TIME_BASE = T.StructType([T.StructField("num", T.IntegerType()), T.StructField("den", T.IntegerType())])

OBSERVATIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("us", T.LongType()),
    T.StructField("arrival_us", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

CHUNKS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("us", T.LongType()),
    T.StructField("arrival_us", T.LongType()),
    T.StructField("latency_us", T.LongType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])

PACKETS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("pts", T.LongType()),
    T.StructField("dts", T.LongType()),
    T.StructField("tb", TIME_BASE),
    T.StructField("size", T.LongType()),
    T.StructField("kind", T.StringType()),
])

STAGE_LOG = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("us", T.LongType()),
    T.StructField("elapsed_us", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("outcome", T.StringType()),
])

ERROR_LOG = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("us", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("errno", T.IntegerType()),
    T.StructField("message", T.StringType()),
])
