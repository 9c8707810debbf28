"""Streaming grid, drift correction, start barrier and strict thinning."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamgrid.functions.scalars import US_PER_SEC, ceil_div, slot_of
from streamgrid.operators.drift import Rule, plan_correction, units_in, us_of_units
from streamgrid.operators.metrics import LATENCY_FLOOR_US, histogram_bucket
from streamgrid.schema import STREAM_KEYS
from streamgrid.streaming.processors import (
    BLOCK_OUTPUT,
    FILL_OUTPUT,
    THIN_OUTPUT,
    Barrier,
    BlockProcessor,
    BucketProcessor,
    Clock,
    Dashboard,
    FillProcessor,
    Grid,
    KeyLogic,
    Merge,
    Release,
    ThinProcessor,
)


def stream_slots(df: DataFrame, period_us: int, origin_us: int, lookahead_us: int, reslot: bool = True) -> DataFrame:
    """Coalesced slots of a stream, each emitted once the watermark has passed it.

    With a known origin a slot, also that of a late row, is a function of the row alone, so the state is one
    aggregate per open slot and rows are combined before the shuffle. With ``reslot`` the watermark trails by
    lookahead + period: a row is moved to a slot that is still open at its arrival, hence never dropped as long
    as rows come in arrival order across micro-batches.
    """
    slot = slot_of("us", F.lit(origin_us), period_us)
    df = df.filter(F.col("us") >= origin_us).withColumn("nominal_slot", slot)
    if reslot:
        open_slot = ceil_div(F.col("arrival_us") - F.lit(origin_us + lookahead_us), period_us)
        df = df.withColumn("slot", F.greatest("nominal_slot", open_slot))
    else:
        df = df.withColumn("slot", F.col("nominal_slot"))
    rank = ["arrival_us", "us", "seq"] if reslot else ["us", "seq"]
    slot_ts = F.timestamp_micros(F.lit(origin_us).cast("bigint") + F.col("slot") * period_us)
    return (
        df.withColumn("slot_ts", slot_ts)
        .withWatermark("slot_ts", f"{lookahead_us + period_us} microseconds")
        .groupBy(*STREAM_KEYS, "slot", "slot_ts")
        .agg(
            F.max(F.struct(*rank, "value")).alias("_last"),
            (F.count(F.lit(1)) - 1).alias("superseded"),
            F.count_if(F.col("slot") > F.col("nominal_slot")).alias("late"),
        )
        .select(*STREAM_KEYS, "slot", "slot_ts", "_last.us", "_last.seq", "_last.value", "superseded", "late")
    )


#: Keys are dealt to so many groups, whose keys share a call, their state accesses and their frames.
BUCKETS = 256


def _by_bucket(
    rows: DataFrame, keys: Sequence[str], logic: KeyLogic, time_mode: str = "EventTime", event_time: str = "",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Run ``logic`` for every key of ``rows``, the keys of a bucket together."""
    whole = [f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)]
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(logic, keys, whole),
        outputStructType=logic.output,
        outputMode="Append",
        timeMode=time_mode,
        eventTimeColumnName=event_time,
    )


def _time_mode(idle_us: int | None) -> str:
    return "None" if idle_us is None else "EventTime"


def stream_fill(slots: DataFrame, max_fill: int, idle_us: int | None = None) -> DataFrame:
    """Bounded gap fill behind ``stream_slots``; the output is a prefix of the batch output."""
    return slots.groupBy(*STREAM_KEYS).transformWithStateInPandas(
        statefulProcessor=FillProcessor(max_fill, idle_us),
        outputStructType=FILL_OUTPUT,
        outputMode="Append",
        timeMode=_time_mode(idle_us),
    )


def stream_clock(
    df: DataFrame, rate: int, max_gap: int, t0_us: int, tb_us: int = US_PER_SEC, units: str = "units"
) -> DataFrame:
    """Counted clock per block, as in the batch correction; the drift columns follow from it."""
    start, n = F.col("us") - F.lit(t0_us), F.col(units).cast("bigint")
    skipped = F.greatest(units_in(-start, rate, tb_us), F.lit(0).cast("bigint"))
    rows = df.withColumn("skipped", skipped).filter(F.col("skipped") < n)
    expected = units_in(start + us_of_units(F.col("skipped"), rate, tb_us), rate, tb_us)
    rows = rows.select(*STREAM_KEYS, "us", "seq", expected.alias("expected"), (n - F.col("skipped")).alias("units"))
    clock = _by_bucket(rows, STREAM_KEYS, Clock(Rule.of(rate, max_gap)), "None")
    return clock.withColumn("drift", F.col("expected") - F.col("counted"))


def _first_per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        firsts = frame.groupby(["session_id", "stream_id"], as_index=False).agg(first_us=("us", "min"), last_us=("us", "max"))
        yield firsts.astype({"first_us": "Int64", "last_us": "Int64"})


FIRSTS = "session_id string, stream_id string, first_us bigint, last_us bigint"


def start_barrier(
    df: DataFrame, participants: int, timeout_us: int, lookahead: str = "0 seconds", idle_us: int | None = None
) -> DataFrame:
    """(session_id, t0) once a session's streams have all reported, or after the timeout in event time.

    A row whose ``us`` is null reports that its stream withdraws. Only the earliest time per stream matters, so
    every Arrow batch is reduced to it before the shuffle and a hot session sends a few rows per batch.
    """
    timed = df.select(*STREAM_KEYS, "us", F.timestamp_micros("us").alias("ts")).withWatermark("ts", lookahead)
    firsts = timed.select(*STREAM_KEYS, "us").mapInPandas(
        _first_per_batch, FIRSTS
    )
    return _by_bucket(firsts, ["session_id"], Barrier(participants, timeout_us, idle_us=idle_us))


def stream_thin(df: DataFrame, idle_us: int | None = None) -> DataFrame:
    """Variable rate with strictly increasing times. To end idle streams, ``df`` needs a watermark."""
    rows = df.select(*STREAM_KEYS, "us", "arrival_us", "seq", "value")
    return rows.groupBy(*STREAM_KEYS).transformWithStateInPandas(
        statefulProcessor=ThinProcessor(idle_us),
        outputStructType=THIN_OUTPUT,
        outputMode="Append",
        timeMode=_time_mode(idle_us),
    )


#: Rows of a session wait under so many keys, so that a hot session is not one.
SALTS = 8


def release_at_origin(
    df: DataFrame, participants: int, timeout_us: int, lookahead: str = "0 seconds", idle_us: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The rows of ``df`` with the common origin ``t0`` of their session, once it is known (see ``start_barrier``).

    Until then rows wait in state. A stream that starts later gets the origin that was resolved without it, and rows
    before the origin come with it as well, so that they can be counted. ``ready_ts`` is the event time of the output:
    the time of the row plus the timeout. Rows without a time only tell that their stream withdraws, rows without
    a session (end marks) only move the watermark.

    With ``idle_us`` (longer than any pause of a session) state ends for sessions that are silent that long.
    """
    rows = df.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lookahead)
    firsts = rows.select(*STREAM_KEYS, "us").mapInPandas(_first_per_batch, FIRSTS)
    origins = _by_bucket(firsts, ["session_id"], Barrier(participants, timeout_us, salts, idle_us), event_time="ts")
    fields = [T.StructField(f.name, f.dataType) for f in df.schema if f.name != "ts"]
    salt = F.pmod(F.xxhash64("stream_id", "us", "seq"), F.lit(salts)).cast("int")
    waiting = rows.filter(F.col("us").isNotNull()).select(
        "ts", *[f.name for f in fields], salt.alias("salt"), F.lit(0).cast("bigint").alias("t0"), F.lit(False).alias("is_origin")
    )
    # Whole numbers are not null in the rows that announce an origin, so that they stay whole numbers in pandas.
    whole = (T.LongType, T.IntegerType, T.ShortType)
    blank = [
        F.lit(0 if isinstance(f.dataType, whole) else None).cast(f.dataType).alias(f.name) for f in fields if f.name != "session_id"
    ]
    told = origins.select("ts", "session_id", *blank, "salt", "t0", F.lit(True).alias("is_origin"))
    logic = Release(fields, timeout_us)
    return _by_bucket(waiting.unionByName(told), ["session_id", "salt"], logic, event_time="ready_ts")


def stream_grid(
    released: DataFrame, period_us: int, max_fill: int | None, timeout_us: int, idle_us: int | None = None
) -> DataFrame:
    """Grid of rows that carry their session's origin (``release_at_origin``), as ``regularise`` makes it.

    Rows are reduced per slot and window of release before the shuffle, so a hot stream sends a row or two per slot.
    """
    slot = slot_of("us", F.col("t0"), period_us)
    slots = (
        released.filter(F.col("us") >= F.col("t0"))
        .withColumn("slot", slot)
        .groupBy(*STREAM_KEYS, "slot", F.window("ready_ts", f"{period_us} microseconds"))
        .agg(F.max(F.struct("us", "seq", "value")).alias("_last"), F.count(F.lit(1)).alias("rows"), F.max("t0").alias("t0"))
        .select(*STREAM_KEYS, "slot", "_last.us", "_last.seq", "_last.value", "rows", "t0")
    )
    return _by_bucket(slots, STREAM_KEYS, Grid(max_fill, period_us, timeout_us, idle_us))


CORRECTION_OUTPUT = (
    "session_id string, stream_id string, us bigint, seq bigint, skipped bigint, expected bigint, units bigint, counted bigint"
)


def stream_correction(
    released: DataFrame, rate: int, max_gap: int, tb_us: int = US_PER_SEC, units: str = "units",
    closed_loop: bool = False, idle_us: int | None = None,
) -> DataFrame:
    """Drift correction of rows that carry their session's origin, block by block as ``apply_corrections`` does it.

    Blocks before the origin come out as ``trimmed``, so that they are counted. State is the counted position of a
    stream; a stream's blocks of a micro-batch are put in order, and micro-batches follow each other in time.
    """
    start, n = F.col("us") - F.col("t0"), F.col(units).cast("bigint")
    skipped = F.greatest(units_in(-start, rate, tb_us), F.lit(0).cast("bigint"))
    rows = released.withColumn("skipped", F.least(skipped, n))
    expected = units_in(start + us_of_units(F.col("skipped"), rate, tb_us), rate, tb_us)
    rows = rows.select(*STREAM_KEYS, "us", "seq", "skipped", expected.alias("expected"), (n - F.col("skipped")).alias("units"))
    rule = Rule.of(rate, max_gap, closed_loop)
    clock = _by_bucket(rows, STREAM_KEYS, Clock(rule, idle_us, CORRECTION_OUTPUT), _time_mode(idle_us))
    planned = plan_correction(clock.withColumn("drift", F.col("expected") - F.col("counted")), rate, max_gap)
    trimmed, drops, zero = F.col("counted").isNull(), F.col("action") == "drop", F.lit(0).cast("bigint")
    amount = F.when(drops, F.least("amount", "units")).otherwise(F.col("amount"))
    return planned.withColumns({
        "amount": F.when(trimmed, zero).otherwise(amount),
        "emitted": F.when(trimmed, zero).otherwise(F.col("units") - F.when(drops, amount).otherwise(zero)),
        "action": F.when(trimmed, "trimmed").otherwise(F.col("action")),
    })


def stream_merge(packets: DataFrame, participants: int) -> DataFrame:
    """Packets (session_id, stream_index, seq, pts, dts, kind) of live streams, merged by (dts, stream_index, seq).

    A stream brings its packets in that order and closes with one of kind ``eof``. ``position`` numbers the rows of a
    session; a row of kind ``complete`` follows the last one.
    """
    rows = packets.select("session_id", "stream_index", "seq", "pts", "dts", "kind")
    return _by_bucket(rows, ["session_id"], Merge(participants), "None")


def stream_reblock(chunks: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` frames of live streams, as ``reblock`` cuts them; a row without samples ends its stream."""
    rows = chunks.select(*STREAM_KEYS, "us", "seq", "channels", "samples")
    return rows.groupBy(*STREAM_KEYS).transformWithStateInPandas(
        statefulProcessor=BlockProcessor(size), outputStructType=BLOCK_OUTPUT, outputMode="Append", timeMode="None"
    )


def stream_dashboard(
    df: DataFrame, tick_us: int, latency: str, counters: Mapping[str, Column], idle_us: int | None = None
) -> DataFrame:
    """One status row per session and tick that saw a row, once the watermark has passed it.

    ``counters`` gives ``dropped`` and ``bytes``; rows are ``received``. Rows are counted per tick and latency bucket
    before the shuffle. Needs a watermark on ``ts``; missing latencies are received, but in no quantile.
    """
    value = F.col(latency).cast("bigint")
    floored = F.when(value.isNotNull(), F.greatest(value, F.lit(LATENCY_FLOOR_US).cast("bigint")))
    high = histogram_bucket(floored)[1]
    ticks = (
        df.groupBy("session_id", F.window("ts", f"{tick_us} microseconds"), high.alias("bucket_high"))
        .agg(F.count(F.lit(1)).alias("received"), *[F.sum(c.cast("bigint")).alias(n) for n, c in counters.items()])
        .select("session_id", F.unix_micros("window.end").alias("at_us"), "bucket_high", "received", *counters)
    )
    return _by_bucket(ticks, ["session_id"], Dashboard(idle_us), _time_mode(idle_us))
