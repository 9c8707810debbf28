"""Quality audits of a regularised output."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.functions.scalars import floor_div
from streamgrid.operators.grid import PART_SLOTS
from streamgrid.operators.ordered import lag, ordered
from streamgrid.schema import STREAM_KEYS


def start_check(df: DataFrame, first: str, lowest: int, highest: int) -> DataFrame:
    """Does every stream start within [lowest, highest]? A grid stream starts at exactly 0."""
    return df.groupBy(*STREAM_KEYS).agg(F.min(first).alias("first")).withColumn(
        "start_ok", F.col("first").between(lowest, highest)
    )


def grid_check(
    slots: DataFrame, at_us: Column, period_us: int, tol_us: int, slot_bound: int | None = None
) -> DataFrame:
    """Intervals between consecutive slots that differ from the period by ``tol_us`` or more.

    ``slots`` has one row per slot, so slot ranges bound the parts.
    """
    part = floor_div("slot", PART_SLOTS)
    rows = ordered(slots.withColumn("_at", at_us), STREAM_KEYS, ["slot"], part=part, rows_bound=slot_bound)
    rows = rows.scan(_previous=lag("_at")).result()
    off = F.abs(F.col("_at") - F.col("_previous") - period_us) >= tol_us
    return rows.groupBy(*STREAM_KEYS).agg(
        F.count("_previous").alias("intervals"), F.count_if(off).alias("irregular")
    ).withColumn("grid_ok", F.col("irregular") == 0)


def rate_check(df: DataFrame, period_us: int, tol_rows: int) -> DataFrame:
    """Rows against duration / period + 1 (needs ``us``)."""
    expected = F.round((F.max("us") - F.min("us")) / period_us).cast("bigint") + 1
    return df.groupBy(*STREAM_KEYS).agg(F.count(F.lit(1)).alias("rows"), expected.alias("expected_rows")).withColumn(
        "rate_ok", F.abs(F.col("rows") - F.col("expected_rows")) <= tol_rows
    )


def observed_rate_check(df: DataFrame, source_rate: float, tol: float, min_secs: float = 0.001) -> DataFrame:
    """Observed rows per second of a variable-rate stream against its source rate."""
    seconds = F.greatest((F.max("us") - F.min("us")) / 1e6, F.lit(min_secs))
    return df.groupBy(*STREAM_KEYS).agg((F.count(F.lit(1)) / seconds).alias("rate")).withColumn(
        "rate_ok", F.abs(F.col("rate") - source_rate) < tol
    )


def conservation(observations: DataFrame, filled: DataFrame) -> DataFrame:
    """Nothing gets lost unnoticed: observations = fresh + superseded + pre-origin + rejected, and
    slots = fresh + filled + skipped.

    ``observations`` are the raw rows, with the session's ``t0`` where it has one. Rows without a key, a time or an
    origin are ``rejected``; those without a key are rows of the result of their own. ``filled`` is the output of
    ``fill_gaps``.
    """
    named = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*STREAM_KEYS, "us", "t0")])
    seen = observations.groupBy(*STREAM_KEYS).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(named & (F.col("us") < F.col("t0"))).alias("pre_origin"),
        F.count_if(~named).alias("rejected"),
    )
    grid = filled.groupBy(*STREAM_KEYS).agg(
        F.count_if(F.col("status") == "fresh").alias("fresh"),
        F.count_if(F.col("status") == "filled").alias("filled"),
        F.sum("lost").alias("skipped"),
        F.sum("superseded").alias("superseded"),
        (F.max("slot_to") - F.min("slot") + 1).alias("slots"),
    )
    zero = F.lit(0).cast("bigint")
    counts = ["fresh", "filled", "skipped", "superseded", "slots"]
    both = seen.join(grid, list(STREAM_KEYS), "left").withColumns({c: F.coalesce(F.col(c), zero) for c in counts})
    return both.withColumn(
        "rows_conserved", F.col("observations") == F.col("fresh") + F.col("superseded") + F.col("pre_origin") + F.col("rejected")
    ).withColumn("slots_conserved", F.col("slots") == F.col("fresh") + F.col("filled") + F.col("skipped"))
