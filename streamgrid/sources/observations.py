"""Scans, event-time selection, back-dating, the malformed-row split and the time spine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamgrid.functions.scalars import frames_of, int_div
from streamgrid.schema import CHUNKS, OBSERVATIONS


def micros(ts: Column | str) -> Column:
    """Event time as BIGINT microseconds, for TIMESTAMP and TIMESTAMP_NTZ (session zone UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def to_schema(df: DataFrame, mapping: Mapping[str, Column], schema: T.StructType) -> DataFrame:
    """Project to a canonical schema; fields that are not mapped become null."""
    unknown = set(mapping) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"not in the canonical schema: {sorted(unknown)}")
    columns = [mapping.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*columns)


# Bounds a micro-batch, and with it what one stream can bring into one state processor call.
BYTES_PER_TRIGGER = 2 * 1024**3


def _scan(
    spark: SparkSession,
    path: str,
    where: Column | None,
    stream_schema: T.StructType | None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    if stream_schema is None:
        df = spark.read.parquet(path)
    elif files_per_trigger:
        df = spark.readStream.schema(stream_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    else:
        df = spark.readStream.schema(stream_schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(path)
    return df if where is None else df.filter(where)


def read_observations(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, Column],
    where: Column | None = None,
    stream_schema: T.StructType | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Scan Parquet into the observation schema; a ``stream_schema`` makes it a streaming scan.

    A micro-batch takes ``files_per_trigger`` files if given, else files up to ``BYTES_PER_TRIGGER``.
    ``where`` is applied to the raw columns, so it reaches the Parquet reader; a filter on the derived ``us``
    would not.
    """
    return to_schema(_scan(spark, path, where, stream_schema, files_per_trigger), mapping, OBSERVATIONS)


def read_chunks(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, Column],
    where: Column | None = None,
    stream_schema: T.StructType | None = None,
) -> DataFrame:
    return to_schema(_scan(spark, path, where, stream_schema), mapping, CHUNKS)


def choose_event_time(df: DataFrame, header: str, arrival: str, out: str = "us") -> DataFrame:
    """Header time when it is positive, else the arrival time; ``used_fallback`` tells which."""
    usable = F.coalesce(F.col(header) > 0, F.lit(False))
    return df.withColumn(out, F.when(usable, F.col(header)).otherwise(F.col(arrival))).withColumn(
        "used_fallback", ~usable
    )


def backdate(df: DataFrame, arrival: str, latency: str, units: str, rate: int, out: str = "us") -> DataFrame:
    """Date the first unit of a chunk: arrival minus latency minus the duration of the chunk."""
    duration = int_div(F.col(units).cast("bigint") * 1_000_000, F.lit(rate).cast("bigint"))
    return df.withColumn(out, F.col(arrival) - F.col(latency) - duration)


def malformed_reason(
    size: Column, announced: Column | None = None, channels: Column | None = None, required: tuple[str, ...] = ()
) -> Column:
    """First reason to reject a row, null for a good row."""
    reason = F.lit(None).cast("string")
    if channels is not None:
        reason = F.when((channels <= 0) | (size % channels != 0), "incomplete").otherwise(reason)
    if announced is not None:
        reason = F.when(size < announced, "short").otherwise(reason)
    reason = F.when(size.isNull() | (size == 0), "empty").otherwise(reason)
    for column in required:
        reason = F.when(F.col(column).isNull(), "null_" + column).otherwise(reason)
    return reason


def split_malformed(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good, rejected); rejected rows keep the reason."""
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def chunk_reason() -> Column:
    """Reject reasons of the chunk schema."""
    return malformed_reason(
        F.size("samples"), channels=F.col("channels"), required=("session_id", "stream_id", "us")
    )


def chunk_frames() -> Column:
    return frames_of("samples", "channels")


def time_spine(spark: SparkSession, start_us: int, end_us: int, period_us: int) -> DataFrame:
    """Absolute deadlines ``start + k * period`` up to ``end`` inclusive, generated in parallel."""
    count = max(0, (end_us - start_us) // period_us + 1)
    return spark.range(count).select(
        F.col("id").alias("k"), (F.lit(start_us) + F.col("id") * F.lit(period_us)).alias("us")
    )


def current_deadline(now_us: Column, origin: Column, index: Column, period_us: int) -> Column:
    """Next index of a generator: a late one jumps to the current index instead of emitting stale rows."""
    behind = now_us - (origin + index * period_us)
    return F.when(behind > period_us, index + int_div(behind, period_us)).otherwise(index)
