"""Counters, latency summaries, snapshots and rates, gauges, losses, utilisation and occupancy."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamgrid.functions.scalars import US_PER_SEC, floor_div
from streamgrid.operators.joins import lookup_join
from streamgrid.operators.ordered import lag, ordered, running_max, running_sum
from streamgrid.schema import STREAM_KEYS

# Fixed value: latencies are floored at 1 us.
LATENCY_FLOOR_US = 1
# Fixed value: three significant digits need 2048 exact buckets, so 11 leading bits are kept.
SIGNIFICANT_BITS = 11
PART_TICKS = 65_536
# Width of a value range, about a second; a group has as many ranges as its largest latency has seconds.
PART_VALUES = 1_048_576


def count_board(df: DataFrame, counters: Mapping[str, Column], by: Sequence[str] = STREAM_KEYS) -> DataFrame:
    """Named conditional counters per group."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in counters.items()])


def _floored(df: DataFrame, latency: str) -> DataFrame:
    """``_v``: latencies of a microsecond at least; a missing one stays missing."""
    value = F.col(latency).cast("bigint")
    floored = F.greatest(value, F.lit(LATENCY_FLOOR_US).cast("bigint"))
    return df.withColumn("_v", F.when(value.isNotNull(), floored))


def latency_summary(df: DataFrame, latency: str, by: Sequence[str], bound_us: int | None = None) -> DataFrame:
    """count, mean, p50, p99 (nearest rank, exact), max, out_of_range and missing per group; null groups are groups.

    Latencies above ``bound_us`` are counted in ``out_of_range`` only, null ones in ``missing`` only. A group's values are counted by value range
    and value, combined before the shuffle. The running count over the ranges tells which range holds a rank, and
    only there are values ranked, so no task holds more than the values of one range, whatever a group's share.
    """
    by = list(by)
    above = F.lit(False) if bound_us is None else F.col("_v") > bound_us
    rows = _floored(df, latency).withColumn("_part", F.when(~above, floor_div("_v", PART_VALUES)))
    counts = rows.groupBy(*by, "_part", F.when(F.col("_part").isNotNull(), F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v").isNull()).alias("_nulls")
    )
    inside = F.col("_part").isNotNull()
    parts = counts.groupBy(*by, "_part").agg(
        F.sum("_n").alias("_rows"), F.sum("_nulls").alias("_nulls"),
        F.sum(F.col("_v") * F.col("_n")).alias("_sum"), F.max("_v").alias("_max"),
    )
    group = W.partitionBy(*by)
    earlier = group.orderBy(F.col("_part").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranges = parts.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        "_total": F.sum(F.when(inside, F.col("_rows"))).over(group),
    })

    def holds(q: float) -> Column:
        rank = F.col("_total") * q
        return inside & (F.col("_before") < rank) & (F.col("_before") + F.col("_rows") >= rank)

    wanted = ranges.filter(holds(0.5) | holds(0.99)).select(
        *[F.col(k).alias(f"_by_{k}") for k in by], F.col("_part").alias("_wanted"), "_before", "_total"
    )
    same = functools.reduce(
        lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_by_{k}")), by, F.col("_part") == F.col("_wanted")
    )
    upto = F.col("_before") + F.sum("_n").over(
        W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    )
    ranked = counts.join(wanted, same).withColumn("_upto", upto)

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.col("_total") * q, F.col("_v")))

    zero = F.lit(0).cast("bigint")
    totals = ranges.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(inside, F.col("_rows"))), zero).alias("count"),
        (F.sum("_sum") / F.sum(F.when(inside, F.col("_rows")))).alias("mean_us"),
        F.max("_max").alias("max_us"),
        F.coalesce(F.sum(F.when(~inside, F.col("_rows") - F.col("_nulls"))), zero).alias("out_of_range"),
        F.coalesce(F.sum("_nulls"), zero).alias("missing"),
    )
    quantiles = ranked.groupBy(*by).agg(quantile(0.5).alias("p50_us"), quantile(0.99).alias("p99_us"))
    named = quantiles.withColumnsRenamed({k: f"_q_{k}" for k in by})
    both = functools.reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_q_{k}")), by, F.lit(True))
    joined = totals.join(named, both, "left") if by else totals.crossJoin(named)
    return joined.select(*by, "count", "mean_us", "p50_us", "p99_us", "max_us", "out_of_range", "missing")


def histogram_bucket(value: Column) -> tuple[Column, Column]:
    """Lowest and highest value of the log-linear bucket a value falls into (three significant digits)."""
    shift = F.greatest(F.length(F.bin(value)) - SIGNIFICANT_BITS, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    return low, low + width - 1


def latency_histogram(
    df: DataFrame, latency: str, by: Sequence[str], bound_us: int | None = None
) -> DataFrame:
    """Mergeable histogram: rows per (group, bucket). Histograms of shards add up bucket by bucket.

    Latencies above ``bound_us`` share the bucket from ``bound_us + 1`` on, whose end is null. Missing latencies are
    in no bucket; ``latency_summary`` counts them.
    """
    low, high = histogram_bucket(F.col("_v"))
    if bound_us is not None:
        above = F.col("_v") > bound_us
        low = F.when(above, F.lit(bound_us + 1)).otherwise(low)
        high = F.when(~above, high)
    return (
        _floored(df, latency)
        .filter(F.col("_v").isNotNull())
        .withColumns({"bucket_low": low, "bucket_high": high})
        .groupBy(*by, "bucket_low", "bucket_high")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def merge_histograms(histograms: DataFrame, by: Sequence[str]) -> DataFrame:
    return histograms.groupBy(*by, "bucket_low", "bucket_high").agg(F.sum("rows").alias("rows"))


def histogram_quantiles(histogram: DataFrame, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles of a histogram, as the highest value of the bucket that holds the rank.

    A group has at most 1024 buckets for each doubling of the value (three digits), so one window per group is safe.
    """
    window = W.partitionBy(*by)
    ranked = histogram.withColumn(
        "_upto", F.sum("rows").over(window.orderBy("bucket_low").rowsBetween(W.unboundedPreceding, 0))
    ).withColumn("_total", F.sum("rows").over(window))
    return ranked.groupBy(*by).agg(*[
        F.min(F.when(F.col("_upto") >= F.col("_total") * q, F.col("bucket_high"))).alias(name)
        for name, q in quantiles.items()
    ])


def snapshots(
    df: DataFrame, tick_us: int, counters: Mapping[str, Column], tick_bound: int | None = None
) -> DataFrame:
    """Cumulative counters at the end of every tick that saw a row.

    ``tick_bound`` is a known bound of the ticks per stream (``span_bound``).
    """
    per_tick = (
        df.withColumn("_tick", floor_div("us", tick_us))
        .groupBy(*STREAM_KEYS, "_tick")
        .agg(*[F.sum(c.cast("bigint")).alias(f"_{name}") for name, c in counters.items()])
    )
    # One row per tick, so a range of ticks bounds a part.
    part = floor_div("_tick", PART_TICKS)
    rows = ordered(per_tick, STREAM_KEYS, ["_tick"], part=part, rows_bound=tick_bound)
    rows = rows.scan(**{name: running_sum(f"_{name}") for name in counters}).result()
    return rows.select(*STREAM_KEYS, ((F.col("_tick") + 1) * tick_us).alias("at_us"), *counters)


def rates(
    snapshot: DataFrame,
    counters: Sequence[str],
    size: str | None = None,
    tick_us: int = US_PER_SEC,
    tick_bound: int | None = None,
) -> DataFrame:
    """Per-second rates between consecutive snapshots.

    A counter that went back gives 0, so does an empty window; the first snapshot of a stream has no rate.
    ``size`` names a byte counter that is also given in bits per second.
    """
    part = floor_div(floor_div("at_us", tick_us), PART_TICKS)
    previous = {f"_{c}": lag(c) for c in [*counters, "at_us"]}
    rows = ordered(snapshot, STREAM_KEYS, ["at_us"], part=part, rows_bound=tick_bound).scan(**previous).result()
    seconds = (F.col("at_us") - F.col("_at_us")) / US_PER_SEC

    def rate(counter: str) -> Column:
        delta = F.greatest(F.col(counter) - F.col(f"_{counter}"), F.lit(0))
        return F.when(seconds <= 0, F.lit(0.0)).otherwise(delta / seconds)

    out = rows.withColumn("window_secs", seconds)
    out = out.withColumns({f"{c}_per_sec": rate(c) for c in counters})
    if size is not None:
        out = out.withColumn(f"{size}_bits_per_sec", rate(size) * 8)
    return out.drop(*previous)


def gauge_statistics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last and largest fill of a queue and their share of the capacity (needs us, seq, used, cap)."""
    last = F.max(F.struct("us", "seq", "used", "cap")).alias("_last")
    return df.groupBy(*by).agg(last, F.max("used").alias("max_used"), F.count(F.lit(1)).alias("samples")).select(
        *by,
        F.col("_last.used").alias("last_used"),
        F.col("_last.cap").alias("cap"),
        "max_used",
        (F.col("_last.used") / F.col("_last.cap")).alias("last_fill"),
        "samples",
    )


def loss_accounting(board: DataFrame) -> DataFrame:
    """Lost = queue drops + skipped slots. Filled and late rows are in the output, hence not lost."""
    overruns = ["intake_overrun", "encoder_overload", "audio_overrun", "disk_write_lag"]
    present = [F.col(c) > 0 for c in overruns if c in board.columns]
    any_overrun = F.lit(False)
    for p in present:
        any_overrun = any_overrun | p
    return board.withColumn("lost", F.col("dropped_queue") + F.col("skipped")).withColumn("any_overrun", any_overrun)


def loss_rollup(df: DataFrame, cause: str, lost: str = "lost") -> DataFrame:
    """Losses per session and cause, per session, and in total; ``level`` is the grouping id."""
    return df.rollup("session_id", cause).agg(
        F.sum(lost).alias("lost"), F.grouping_id().cast("bigint").alias("level")
    )


def run_rates(df: DataFrame, counters: Mapping[str, Column], by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Whole-run rates; a run without extent is divided by 1e-9 s rather than by zero."""
    out = df.groupBy(*by).agg(
        ((F.max("us") - F.min("us")) / US_PER_SEC).alias("wall_secs"),
        *[F.sum(c.cast("bigint")).alias(name) for name, c in counters.items()],
    )
    seconds = F.greatest(F.col("wall_secs"), F.lit(1e-9))
    return out.withColumns({f"{name}_per_sec": F.col(name) / seconds for name in counters})


def threshold_breaches(df: DataFrame, thresholds: DataFrame, elapsed: str, by: Sequence[str]) -> DataFrame:
    """Rows slower than their group's ``threshold_us``."""
    rows = lookup_join(df, thresholds, list(by), spread_by=["us", "seq"])
    over = F.col(elapsed) > F.col("threshold_us")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(over).alias("breaches"),
        F.coalesce(F.max(F.when(over, F.col(elapsed))), F.lit(0).cast("bigint")).alias("worst_us"),
    )


def utilisation(
    samples: DataFrame, ticks: str, hz: float, cpus: int, hot_rows: int | None = None, rows_bound: int | None = None
) -> DataFrame:
    """Cores in use, percent of one core and of the machine, between samples of a cumulative tick counter."""
    rows = ordered(samples, STREAM_KEYS, ["us"], hot_rows=hot_rows, rows_bound=rows_bound)
    rows = rows.scan(_us=lag("us"), _ticks=lag(ticks)).result()
    seconds = (F.col("us") - F.col("_us")) / US_PER_SEC
    cores = F.when(seconds > 0, F.greatest(F.col(ticks) - F.col("_ticks"), F.lit(0)) / hz / seconds)
    return (
        rows.withColumn("cores", cores)
        .withColumn("percent_of_core", F.col("cores") * 100.0)
        .withColumn("percent_of_machine", F.col("cores") * 100.0 / cpus)
        .drop("_us", "_ticks")
    )


def resource_peaks(df: DataFrame, memory: str, optional: str, by: Sequence[str]) -> DataFrame:
    """Peak of one measure and mean of an optional one (null without any sample)."""
    return df.groupBy(*by).agg(F.max(memory).alias("peak"), F.avg(optional).alias("mean_optional"))


def occupancy(
    events: DataFrame, capacity: int, key: str = "session_id", hot_rows: int | None = None
) -> DataFrame:
    """Fill of a queue after every event; ``delta`` is +1 for an offer and -1 for a take.

    Events are in the order of us, at one instant offers first, then seq: what is taken was offered before.

    ``inflight`` is the fill of an unbounded queue. ``length`` is the fill of a queue that drops the newest
    offer when full, and ``overflow`` the offers dropped so far: the running excess over the capacity. Takes
    are of accepted offers, so the bounded queue never goes below zero.
    """
    rows = ordered(events.withColumn("_turn", -F.col("delta")), [key], ["us", "_turn", "seq"], hot_rows=hot_rows)
    rows = rows.scan(inflight=running_sum(F.col("delta").cast("bigint")))
    rows = rows.with_columns(above=F.col("inflight") > capacity, _excess=F.col("inflight") - capacity)
    rows = rows.scan(overflow=running_max(F.greatest(F.col("_excess"), F.lit(0))))
    return rows.with_columns(length=F.col("inflight") - F.col("overflow")).result().drop("_excess", "_turn")


def occupancy_summary(occupied: DataFrame, key: str = "session_id") -> DataFrame:
    return occupied.groupBy(key).agg(
        F.count_if(F.col("delta") > 0).alias("offers"),
        F.max("inflight").alias("max_inflight"),
        F.count_if(F.col("above") & (F.col("delta") > 0)).alias("offers_above"),
    )


def stream_counts(df: DataFrame) -> DataFrame:
    """Distinct streams per session; streams are reduced first, so a hot session stays cheap."""
    return df.select(*STREAM_KEYS).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("streams"))


def stage_columns(summary: DataFrame, key: str, stage: str, stages: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long stage summaries to one wide row per session; the stage list is fixed, so no extra job is needed."""
    return summary.groupBy(key).pivot(stage, list(stages)).agg(*[F.first(m).alias(m) for m in measures])
