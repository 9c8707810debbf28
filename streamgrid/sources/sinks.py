"""Ordered, segmented output and its read-back check."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.functions.scalars import floor_div
from streamgrid.schema import STREAM_KEYS
from streamgrid.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def with_segment(df: DataFrame, gop: int, slot: str = "slot") -> DataFrame:
    """Number of the independently readable segment a slot belongs to."""
    return df.withColumn("segment", floor_div(slot, gop))


def write_merged(
    df: DataFrame, path: str, order: Sequence[str] = ("us", "stream_id", "seq"), partition_by: Sequence[str] = ()
) -> None:
    """Write in merge order.

    Rows are range-partitioned on (partition columns, order), so files are disjoint in time, a hot segment is
    spread over several files, and every file is sorted.
    """
    keys = [*partition_by, *order]
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def extent_summary(df: DataFrame) -> DataFrame:
    """Rows and time range per stream: the quantities a read-back has to reproduce."""
    return df.groupBy(*STREAM_KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.min("us").alias("min_us"), F.max("us").alias("max_us")
    )


def verify_written(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Re-read ``path`` and compare with ``expected``; one row per stream of either side."""
    written = extent_summary(spark.read.parquet(path)).withColumnsRenamed(
        {"rows": "rows_read", "min_us": "min_us_read", "max_us": "max_us_read"}
    )
    both = extent_summary(expected).join(written, list(STREAM_KEYS), "full")
    same = (
        F.col("rows").eqNullSafe(F.col("rows_read"))
        & F.col("min_us").eqNullSafe(F.col("min_us_read"))
        & F.col("max_us").eqNullSafe(F.col("max_us_read"))
    )
    return both.withColumn("ok", same)
