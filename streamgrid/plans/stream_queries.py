"""Streaming forms over the events table, in several micro-batches, run to completion.

Append mode emits what the watermark has passed; where that matters an end mark moves it past everything open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.operators import blocks
from streamgrid.plans.align_queries import MAX_GAP, RATE, TB_US, block_ends, sql_clock, sql_correction
from streamgrid.plans.inputs import (
    DAY,
    HOUR,
    STREAM_NAMES,
    USER_SESSION,
    chunks_stream,
    events_stream,
    packets_stream,
    sql_fill,
    sql_observations,
    sql_origin,
    units_of,
    vector_chunks,
)
from streamgrid.plans.registry import SQL, query
from streamgrid.sources.sinks import scratch_path
from streamgrid.streaming import operators, sinks, windows

# 2024-01-01 00:00 UTC, the start of the events table.
ORIGIN = 1_704_067_200_000_000


@query("stream_tick_counters", f"""WITH {sql_observations()},
t AS (SELECT session_id, stream_id, us // {6 * HOUR} AS k, count(*) AS rows, count(*) FILTER (value > 150) AS dropped
  FROM obs GROUP BY ALL)
SELECT session_id, stream_id, k * {6 * HOUR} AS from_us, (k + 1) * {6 * HOUR} AS to_us, rows, dropped FROM t""")
def stream_tick_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.with_lookahead(events_stream(spark, sf_dir, end_mark=True), "1 hour")
    counters = {"rows": F.lit(1), "dropped": F.col("value") > 150}
    return sinks.drain(spark, windows.tick_counters(rows, "6 hours", counters), "ticks")


@query("stream_sessions", f"""WITH {sql_observations()},
g AS (SELECT *, coalesce(us - lag(us) OVER w >= {2 * HOUR}, FALSE) AS brk FROM obs WINDOW w AS (PARTITION BY stream_id ORDER BY us)),
s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY stream_id ORDER BY us) AS seg FROM g)
SELECT session_id, stream_id, count(*) AS rows, min(us) AS from_us, max(us) AS to_us FROM s GROUP BY session_id, stream_id, seg""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.with_lookahead(events_stream(spark, sf_dir, end_mark=True), "1 hour")
    return sinks.drain(spark, windows.gap_sessions(rows, "2 hours"), "sessions")


@query("stream_thin_duplicates", f"""WITH {sql_observations()}
SELECT stream_id, us // {HOUR} AS tick, count(DISTINCT us // {HOUR}) AS rows FROM obs GROUP BY 1, 2""")
def stream_thin_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stream and hour."""
    rows = windows.with_lookahead(events_stream(spark, sf_dir), "3 hours")
    thinned = windows.thin_duplicates(rows, HOUR).select("stream_id", "tick")
    return sinks.drain(spark, thinned, "thin").groupBy("stream_id", "tick").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_grid_fill", f"""WITH {sql_observations()},
n AS (SELECT *, (us - {ORIGIN} + {HOUR // 2}) // {HOUR} AS nominal FROM obs WHERE us >= {ORIGIN}),
e AS (SELECT *, greatest(nominal, CAST(ceil((arrival_us - {ORIGIN} - {HOUR // 2}) / {HOUR}.0) AS BIGINT)) AS slot FROM n),
c AS (SELECT stream_id, slot, arg_max(us, (arrival_us, us, seq)) AS us, arg_max(value, (arrival_us, us, seq)) AS value,
  count(*) - 1 AS superseded, count(*) FILTER (slot > nominal) AS late FROM e GROUP BY stream_id, slot),
r AS (SELECT *, lead(slot) OVER (PARTITION BY stream_id ORDER BY slot) AS nxt FROM c)
SELECT stream_id, slot, slot AS slot_to, 'fresh' AS status, us, value, superseded, late, 0::BIGINT AS lost FROM r
UNION ALL SELECT stream_id, s, s, 'filled', us, value, 0, 0, 0 FROM (SELECT *, unnest(range(slot + 1, nxt)) AS s FROM r
  WHERE nxt - slot > 1 AND nxt - slot - 1 <= 1)
UNION ALL SELECT stream_id, slot + 1, nxt - 1, 'skipped', NULL, NULL, 0, 0, nxt - slot - 1 FROM r WHERE nxt - slot - 1 > 1""")
def stream_grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly grid with late rows re-slotted, gaps of one slot filled, longer ones skipped."""
    slots = operators.stream_slots(
        events_stream(spark, sf_dir, by_arrival=True, end_mark=True), HOUR, ORIGIN, HOUR // 2
    )
    filled = sinks.drain(spark, operators.stream_fill(slots, max_fill=1), "grid")
    return filled.drop("session_id", "seq")


@query("stream_clock", f"""WITH RECURSIVE {sql_clock(str(ORIGIN + DAY))}
SELECT stream_id, seq, expected, m AS units, counted, drift FROM step""")
def stream_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_stream(spark, sf_dir).withColumn("units", units_of())
    clock = operators.stream_clock(rows, RATE, MAX_GAP, ORIGIN + DAY, tb_us=TB_US)
    return sinks.drain(spark, clock, "clock").select("stream_id", "seq", "expected", "units", "counted", "drift")


@query("stream_barrier", f"""WITH {sql_observations('CAST(user_id AS VARCHAR)')},
f AS (SELECT session_id, stream_id, min(us) AS f FROM obs GROUP BY ALL),
e AS (SELECT session_id, min(f) AS e, count(*) AS n FROM f GROUP BY session_id)
SELECT session_id, max(f) AS t0, count(*) AS streams, max(n) < 5 OR count(*) < max(n) AS timed_out FROM f JOIN e USING (session_id)
WHERE f <= e + {2 * DAY} GROUP BY session_id""")
def stream_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of user sessions: all five streams, or those within two days of the earliest."""
    rows = events_stream(spark, sf_dir, session="CAST(user_id AS STRING)", end_mark=True)
    return sinks.drain(spark, operators.start_barrier(rows, participants=5, timeout_us=2 * DAY), "barrier")


@query("stream_thin", f"""WITH {sql_observations()},
t AS (SELECT stream_id, us, seq, value, max(us) OVER (PARTITION BY stream_id ORDER BY arrival_us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM obs)
SELECT stream_id, us, seq, value FROM t WHERE latest IS NULL OR us > latest""")
def stream_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    thinned = operators.stream_thin(events_stream(spark, sf_dir, by_arrival=True))
    return sinks.drain(spark, thinned, "strict").select("stream_id", "us", "seq", "value")


@query("stream_status", f"""WITH {sql_observations()}
SELECT session_id, count(*) AS rows, min(us) AS from_us, max(us) AS to_us FROM obs GROUP BY session_id""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "status")
    sinks.write_status(events_stream(spark, sf_dir), path + "/data", path + "/checkpoint")
    status = spark.read.parquet(path + "/data")
    return status.groupBy("session_id").agg(
        F.sum("rows").alias("rows"), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us")
    )


# --- live origin per session: user sessions, five streams each, a timeout of two days ------------------------------

SQL_USER = "CAST(user_id AS VARCHAR)"
TIMEOUT = 2 * DAY
# Longer than any pause of a user, and shorter than the time that the end mark lies behind the data.
IDLE = 29 * DAY
GRID_PERIOD, GRID_FILL = 6 * HOUR, 8


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_stream(spark, sf_dir, session=USER_SESSION, end_mark=True, end_after_us=70 * DAY).drop("ts", "arrival_us")
    return operators.release_at_origin(rows.withColumn("units", units_of()), 5, TIMEOUT, idle_us=IDLE)


@query("stream_grid_by_user", f"""WITH {sql_fill(GRID_PERIOD, GRID_FILL, SQL_USER, TIMEOUT)}
SELECT session_id, stream_id, slot, slot_to, status, us, seq, value, superseded, lost FROM filled""")
def stream_grid_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's grid starts at the origin that the barrier found for the user; rows wait for it."""
    grid = operators.stream_grid(_released(spark, sf_dir), GRID_PERIOD, GRID_FILL, TIMEOUT, IDLE)
    return sinks.drain(spark, grid, "user-grid").drop("late")


@query("stream_early_rows", f"""WITH {sql_origin(SQL_USER, TIMEOUT)}
SELECT session_id, stream_id, min(t0) AS t0, count(*) AS rows, count(*) FILTER (us < t0) AS early
FROM obs JOIN origin USING (session_id) GROUP BY ALL""")
def stream_early_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released rows, and how many of them lie before the origin."""
    rows = sinks.drain(spark, _released(spark, sf_dir).select("session_id", "stream_id", "us", "t0"), "released")
    return rows.groupBy("session_id", "stream_id").agg(
        F.min("t0").alias("t0"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("us") < F.col("t0")).alias("early")
    )


@query("stream_correction", sql_correction(f"max(us) FILTER (us <= earliest + {TIMEOUT})", session=SQL_USER))
def stream_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift correction from every user's own origin: trimmed, inserted, dropped and compensated blocks."""
    blocks = operators.stream_correction(_released(spark, sf_dir), RATE, MAX_GAP, tb_us=TB_US, idle_us=IDLE)
    corrected = ["session_id", "stream_id", "seq", "skipped", "counted", "action", "amount", "emitted"]
    return sinks.drain(spark, blocks, "correction").select(*corrected)


# --- live merge, blocks and status rows ----------------------------------------------------------------------------

SQL_INDEX = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(STREAM_NAMES)) + " END"


@query("stream_merge", f"""WITH p AS (SELECT {SQL_USER} AS session_id, {SQL_INDEX} AS stream_index, event_id AS seq,
  epoch_us(ts) AS pts, epoch_us(ts) AS dts FROM events)
SELECT session_id, 'data' AS kind, stream_index::INT AS stream_index, seq, pts, dts,
  row_number() OVER (PARTITION BY session_id ORDER BY dts, stream_index, seq) AS position FROM p
UNION ALL SELECT session_id, 'complete', NULL, NULL, NULL, NULL, count(*) FROM p GROUP BY session_id""")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of every user in time order, although each runs a day behind the one before."""
    return sinks.drain(spark, operators.stream_merge(packets_stream(spark, sf_dir), len(STREAM_NAMES)), "merge")


@query("stream_reblock", SQL["reblock"])
def stream_reblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 26 to 32 frames to blocks of 48 frames, carried over micro-batches."""
    chunks = vector_chunks(spark, sf_dir).withColumn("excess", F.col("seq") % 7)
    out = sinks.drain(spark, operators.stream_reblock(chunks_stream(blocks.head_drop(chunks, "excess")), 48), "blocks")
    return out.select(F.col("stream_id").cast("int").alias("label"), "block", "pts", "frames", "is_partial", *block_ends())


SQL_LATENCY = "greatest(((event_id * 7919) % 70000) * 1000, 1)"


@query("stream_dashboard", f"""WITH r AS (SELECT {SQL_USER} AS session_id, (epoch_us(ts) // {GRID_PERIOD} + 1) * {GRID_PERIOD} AS at_us,
  value, {SQL_LATENCY} AS v FROM events),
b AS (SELECT *, greatest(length(bin(v)) - 11, 0)::INT AS k, CAST(round(value * 100) AS BIGINT) AS size FROM r),
h AS (SELECT *, ((v >> k) << k) + (1::BIGINT << k) - 1 AS high FROM b),
t AS (SELECT DISTINCT session_id, at_us FROM h),
c AS (SELECT t.session_id, t.at_us, count(*) AS received, count(*) FILTER (value > 150) AS dropped, sum(size)::BIGINT AS bytes,
  quantile_disc(high, 0.5) AS p50_us, quantile_disc(high, 0.99) AS p99_us
  FROM t JOIN h ON h.session_id = t.session_id AND h.at_us <= t.at_us GROUP BY ALL),
l AS (SELECT *, (at_us - lag(at_us) OVER w) / 1000000 AS secs, received - lag(received) OVER w AS dr, bytes - lag(bytes) OVER w AS db
  FROM c WINDOW w AS (PARTITION BY session_id ORDER BY at_us))
SELECT session_id, at_us, received, dropped, bytes, secs AS window_secs, round(dr / secs, 12) AS received_per_sec,
  round(db / secs * 8, 9) AS bytes_bits_per_sec, p50_us, p99_us FROM l""")
def stream_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, rates and latency quantiles of every user, at each tick of six hours."""
    rows = windows.with_lookahead(events_stream(spark, sf_dir, session=USER_SESSION, end_mark=True, end_after_us=70 * DAY), "1 hour")
    rows = rows.withColumn("latency_us", F.expr("((seq * 7919) % 70000) * 1000"))
    counters = {"dropped": F.col("value") > 150, "bytes": F.round(F.col("value") * 100)}
    status = sinks.drain(spark, operators.stream_dashboard(rows, GRID_PERIOD, "latency_us", counters, IDLE), "dashboard")
    return status.withColumns({
        "received_per_sec": F.round("received_per_sec", 12), "bytes_bits_per_sec": F.round("bytes_bits_per_sec", 9),
    })
