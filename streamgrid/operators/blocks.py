"""Array-valued streams: trimming, gap rows, head drop, fixed-size blocks, channel split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.functions.scalars import US_PER_SEC, frames_of, int_div
from streamgrid.operators.drift import units_in
from streamgrid.operators.ordered import ordered, running_sum
from streamgrid.schema import STREAM_KEYS

FRAME_SIZE = 1024


def drop_head(samples: Column, frames: Column, channels: Column) -> Column:
    """Remove ``frames`` whole frames from the head of an interleaved array."""
    skip = (frames * channels).cast("int")
    return F.slice(samples, skip + 1, F.greatest(F.size(samples) - skip, F.lit(0)))


def leading_trim(df: DataFrame, rate: int, tb_us: int = US_PER_SEC) -> DataFrame:
    """Cut the units before ``t0``; chunks wholly before it are dropped. Adds ``skipped``."""
    frames = frames_of("samples", "channels")
    skipped = F.greatest(units_in(F.col("t0") - F.col("us"), rate, tb_us), F.lit(0).cast("bigint"))
    kept = df.withColumn("skipped", skipped).filter(F.col("skipped") < frames)
    return kept.withColumn("samples", drop_head(F.col("samples"), F.col("skipped"), F.col("channels")))


def head_drop(df: DataFrame, excess: str) -> DataFrame:
    """Drop min(excess, available) frames from the head and tell how many."""
    frames = frames_of("samples", "channels")
    dropped = F.least(F.greatest(F.col(excess).cast("bigint"), F.lit(0).cast("bigint")), frames)
    return df.withColumn("dropped", dropped).withColumn(
        "samples", drop_head(F.col("samples"), F.col("dropped"), F.col("channels"))
    )


def fill_blocks(df: DataFrame, missing: str, chunk: int = FRAME_SIZE, spread: int = 4096) -> DataFrame:
    """One row per block of at most ``chunk`` units for every gap of ``missing`` units; the last may be shorter.

    Two nested explodes keep the generated arrays short however long the gap is.
    """
    missing = F.col(missing).cast("bigint")
    last = int_div(missing - 1, chunk)
    outer = df.filter(missing > 0).withColumn(
        "_first", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(spread).cast("bigint")))
    )
    inner = F.sequence(F.col("_first"), F.least(F.col("_first") + spread - 1, last))
    return (
        outer.withColumn("block", F.explode(inner))
        .withColumn("units", F.least(F.lit(chunk).cast("bigint"), missing - F.col("block") * chunk))
        .drop("_first")
    )


def silence(units: Column, channels: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), (units * channels).cast("int"))


def reblock(df: DataFrame, size: int = FRAME_SIZE, hot_rows: int | None = None) -> DataFrame:
    """Cut variable chunks into blocks of ``size`` frames, order kept; only a stream's last block is partial.

    Chunks are sliced at block boundaries before the shuffle, so whole slices travel rather than single
    samples, and a group never holds more than one block.
    """
    rows = ordered(df, STREAM_KEYS, ["us", "seq"], hot_rows=hot_rows)
    rows = rows.with_columns(_frames=frames_of("samples", "channels"))
    chunks = rows.scan(_offset=running_sum("_frames", inclusive=False)).result().filter(F.col("_frames") > 0)
    offset, frames, channels = F.col("_offset"), F.col("_frames"), F.col("channels")
    last = int_div(offset + frames - 1, size)
    pieces = chunks.withColumn("block", F.explode(F.sequence(int_div(offset, size), last)))
    start = F.greatest(F.col("block") * size, offset)
    stop = F.least((F.col("block") + 1) * size, offset + frames)
    piece = F.slice("samples", ((start - offset) * channels + 1).cast("int"), ((stop - start) * channels).cast("int"))
    return (
        pieces.select(*STREAM_KEYS, "block", "channels", F.struct(start.alias("at"), piece.alias("samples")).alias("p"))
        .groupBy(*STREAM_KEYS, "block")
        .agg(F.max("channels").alias("channels"), F.array_sort(F.collect_list("p")).alias("_pieces"))
        .withColumn("samples", F.flatten(F.transform("_pieces", lambda p: p["samples"])))
        .withColumn("pts", F.col("block") * size)
        .withColumn("frames", frames_of("samples", "channels"))
        .withColumn("is_partial", F.col("frames") < size)
        .drop("_pieces")
    )


def deinterleave(samples: Column, channels: int) -> Column:
    """Interleaved samples to one array per channel."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: F.filter(samples, lambda _, i: i % channels == c),
    )
