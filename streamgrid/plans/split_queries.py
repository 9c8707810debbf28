"""Queries whose streams are cut into parts although they are short: the same rows as their unsplit forms.

A stream is cut from ``HOT`` rows on, so every stream of the events table takes the path of a very long one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.operators import align, drift, grid, merge, metrics
from streamgrid.operators.joins import lookup_join
from streamgrid.plans import metric_queries
from streamgrid.plans.align_queries import CORRECTED, MAX_GAP, RATE, TB_US, blocks_after_a_day
from streamgrid.plans.inputs import DAY, HOUR, events, sql_observations, units_of, user_events
from streamgrid.plans.regularise import anchored
from streamgrid.plans.registry import SQL, query

HOT = 100


@query("counted_pts_split", SQL["counted_pts"])
def counted_pts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchored(events(spark, sf_dir)).withColumn("units", units_of()).withColumn("anchor_us", F.col("t0"))
    counted = drift.drift(drift.counted_pts(rows, hot_rows=HOT), RATE, tb_us=TB_US)
    return counted.select("stream_id", "seq", "counted", "media_us")


@query("asof_latest_split", SQL["asof_latest"])
def asof_latest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    both = align.asof_latest(rows.filter("stream_id = 'click'"), rows.filter("stream_id = 'view'"), hot_rows=HOT)
    return both.select("us", "side", "seq", "latest_left", "latest_right")


@query("gap_segments_split", SQL["gap_segments"])
def gap_segments_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drift.segment_by_gap(events(spark, sf_dir), F.lit(HOUR // 2), HOUR, hot_rows=HOT)
    return cut.groupBy("stream_id", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("us").alias("from_us"), F.max("us").alias("to_us")
    )


@query("applied_correction_split", SQL["applied_correction"])
def applied_correction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_after_a_day(spark, sf_dir)
    return drift.apply_corrections(rows, RATE, MAX_GAP, tb_us=TB_US, hot_rows=HOT).select(*CORRECTED)


@query("applied_correction_closed_loop_split", SQL["applied_correction_closed_loop"])
def applied_correction_closed_loop_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_after_a_day(spark, sf_dir)
    return drift.apply_corrections(rows, RATE, MAX_GAP, tb_us=TB_US, hot_rows=HOT, closed_loop=True).select(*CORRECTED)


@query("failure_streaks_split", SQL["failure_streaks"])
def failure_streaks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_events(spark, sf_dir)
    failed = F.col("stream_id").isin("error", "view")
    rows = rows.withColumn("failed", failed).withColumn("stream_id", F.lit("all"))
    streaks = merge.failure_streaks(rows, F.col("failed"), hot_rows=10)
    return streaks.select("session_id", "failures", "from_us", "to_us")


@query("occupancy_split", SQL["occupancy"])
def occupancy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupied = metrics.occupancy(metric_queries._queue_events(spark, sf_dir), 15, hot_rows=HOT)
    return occupied.select("us", "delta", "seq", "inflight", "above")


@query("bounded_queue_split", SQL["bounded_queue"])
def bounded_queue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and overflow carried over the parts."""
    return metric_queries.bounded_queue(spark, sf_dir, hot_rows=HOT)


@query("row_cap_split", f"""WITH {sql_observations()},
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY us, seq) AS rank FROM obs)
SELECT stream_id, seq, us FROM r WHERE rank <= 1200""")
def row_cap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows than a window group limit takes."""
    return grid.cap_rows(events(spark, sf_dir), 1200, hot_rows=HOT).select("stream_id", "seq", "us")
