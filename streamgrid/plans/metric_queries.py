"""Merging, errors, counters, latency, snapshots, losses, verdicts, planning and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.functions import scalars
from streamgrid.operators import merge, metrics, planning, rules
from streamgrid.operators import verdict as verdicts
from streamgrid.operators.ordered import span_bound
from streamgrid.plans.inputs import (
    HOUR,
    USER_SESSION,
    events,
    sql_fill,
    sql_observations,
    table,
    user_events,
)
from streamgrid.plans.registry import query
from streamgrid.plans.regularise import regularise
from streamgrid.sources.observations import micros

SQL_USER = "CAST(user_id AS VARCHAR)"
PERIOD = 6 * HOUR
STAGES = ("click", "error", "purchase", "signup", "view")
LATENCY = "((event_id * 7919) % 70000) * 1000"


# --- merging -------------------------------------------------------------------------------------------------------


@query("interleave", """SELECT 0 AS stream_index, o_orderkey AS seq, epoch_us(o_orderdate) AS pts, epoch_us(o_orderdate) AS dts
FROM orders UNION ALL
SELECT 1, l_orderkey * 10 + l_linenumber, epoch_us(l_shipdate) + l_linenumber * 1000, epoch_us(l_shipdate) FROM lineitem""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in milliseconds and line items in microseconds, merged by time."""
    order_ms = scalars.int_div(micros("o_orderdate"), 1000)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), order_ms.alias("pts"), order_ms.alias("dts")
    )
    shipped = micros("l_shipdate")
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (shipped + F.col("l_linenumber") * 1000).alias("pts"),
        shipped.alias("dts"),
    )
    return merge.interleave((orders, (1, 1000)), (items, (1, 1_000_000))).select("stream_index", "seq", "pts", "dts")


@query("merge_order_check", f"""WITH {sql_observations()},
p AS (SELECT session_id, stream_id, seq, us AS pts, arrival_us - 3600000000 AS dts FROM obs),
l AS (SELECT *, lag(dts) OVER (PARTITION BY stream_id ORDER BY seq) AS prev FROM p)
SELECT session_id, stream_id, count(*) AS packets, count(*) FILTER (dts < prev) AS dts_backward,
  count(*) FILTER (pts < dts) AS pts_before_dts, min(pts) AS first_pts, max(pts) AS last_pts FROM l GROUP BY ALL""")
def merge_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = events(spark, sf_dir).withColumn("pts", F.col("us")).withColumn("dts", F.col("arrival_us") - HOUR)
    return merge.merge_order_check(packets)


@query("stream_completion", f"""WITH {sql_observations(SQL_USER)},
s AS (SELECT session_id, stream_id, count(*) AS n FROM obs GROUP BY ALL)
SELECT session_id, count(*) AS streams, count(*) FILTER (n % 9 <> 0) AS ended, CAST(sum(n) AS BIGINT) AS packets,
  count(*) = count(*) FILTER (n % 9 <> 0) AS complete FROM s GROUP BY session_id""")
def stream_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose row count is a multiple of nine never send their end mark."""
    rows = user_events(spark, sf_dir)
    keys = ["session_id", "stream_id"]
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 9 != 0)
    packets = rows.select(*keys, F.lit("data").alias("kind")).unionByName(ends.select(*keys, F.lit("eof").alias("kind")))
    return merge.stream_completion(packets)


SQL_ERRORS = f"""err AS (SELECT {SQL_USER} AS session_id, event_type AS stream_id, event_id AS seq, epoch_us(ts) AS us,
  CASE event_id % 6 WHEN 0 THEN 'write' WHEN 1 THEN 'mux' WHEN 2 THEN 'encode' WHEN 3 THEN 'audio_intake'
    WHEN 4 THEN 'eagain' ELSE 'eof' END AS raw, CASE WHEN event_id % 4 = 0 THEN 28 ELSE 5 END AS errno
  FROM events WHERE event_type = 'error'),
cls AS (SELECT *, CASE WHEN raw = 'write' AND errno = 28 THEN 'disk_full' WHEN raw = 'write' THEN 'disk_write'
  ELSE raw END AS kind FROM err)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, where=F.col("event_type") == "error", session=USER_SESSION)
    raw = F.element_at(
        F.array(*[F.lit(k) for k in ("write", "mux", "encode", "audio_intake", "eagain", "eof")]),
        (F.col("seq") % 6 + 1).cast("int"),
    )
    rows = rows.withColumn("raw", raw).withColumn("errno", F.when(F.col("seq") % 4 == 0, 28).otherwise(5))
    return rows.withColumn("kind", scalars.classify_error("raw", "errno"))


@query("error_class", f"""WITH {SQL_ERRORS}
SELECT kind, kind IN ('disk_full', 'disk_write', 'mux', 'no_usable_encoder', 'pipeline_aborted') AS fatal,
  kind NOT IN ('eagain', 'eof') AS failure, count(*) AS rows FROM cls GROUP BY ALL""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir).select(
        "kind", scalars.is_fatal("kind").alias("fatal"), scalars.is_failure("kind").alias("failure")
    )
    return rows.groupBy("kind", "fatal", "failure").agg(F.count(F.lit(1)).alias("rows"))


@query("first_error", f"""WITH {SQL_ERRORS},
r AS (SELECT *, CASE kind WHEN 'disk_full' THEN 0 WHEN 'disk_write' THEN 0 WHEN 'mux' THEN 0 WHEN 'encode' THEN 1 ELSE 2 END
  AS severity FROM cls WHERE kind NOT IN ('eagain', 'eof'))
SELECT session_id, arg_min(severity, (severity, us, seq)) AS severity, arg_min(us, (severity, us, seq)) AS us,
  arg_min(seq, (severity, us, seq)) AS seq, arg_min(kind, (severity, us, seq)) AS kind, count(*) AS errors
FROM r GROUP BY session_id""")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write errors come first, then encoding, then intake; among equals the earliest."""
    failures = _errors(spark, sf_dir).filter(scalars.is_failure("kind"))
    severity = F.when(F.col("kind").isin("disk_full", "disk_write", "mux"), 0).when(F.col("kind") == "encode", 1).otherwise(2)
    return merge.first_error(failures, severity).select("session_id", "severity", "us", "seq", "kind", "errors")


@query("failure_streaks", """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, epoch_us(ts) AS us,
    event_type IN ('error', 'view') AS failed FROM events),
i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, seq) AS island FROM u)
SELECT session_id, count(*) AS failures, min(us) AS from_us, max(us) AS to_us FROM i WHERE failed
GROUP BY session_id, island HAVING count(*) >= 5""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per user; errors and views stand for failed reads."""
    rows = user_events(spark, sf_dir)
    failed = F.col("stream_id").isin("error", "view")
    rows = rows.withColumn("failed", failed).withColumn("stream_id", F.lit("all"))
    streaks = merge.failure_streaks(rows, F.col("failed"))
    return streaks.select("session_id", "failures", "from_us", "to_us")


# --- counters and latency ------------------------------------------------------------------------------------------

SQL_LATENCY = f"""lat AS (SELECT event_type AS stream_id,
    CASE WHEN {LATENCY} IS NOT NULL THEN greatest({LATENCY}, 1) END AS v FROM events),
ok AS (SELECT * FROM lat)"""
SQL_BUCKET = """hist AS (SELECT stream_id, (v >> k) << k AS bucket_low, ((v >> k) << k) + (1::BIGINT << k) - 1 AS bucket_high,
  count(*) AS rows FROM (SELECT *, greatest(length(bin(v)) - 11, 0)::INT AS k FROM ok WHERE v IS NOT NULL) GROUP BY ALL)"""


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), F.expr(LATENCY).alias("latency_us"))
    return rows


@query("latency_summary", f"""WITH {SQL_LATENCY}
SELECT stream_id, count(v) AS count, round(CAST(sum(v) AS DOUBLE) / count(v), 3) AS mean_us, quantile_disc(v, 0.5) AS p50_us,
  quantile_disc(v, 0.99) AS p99_us, max(v) AS max_us, CAST(0 AS BIGINT) AS out_of_range,
  count(*) FILTER (v IS NULL) AS missing FROM ok GROUP BY stream_id""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.latency_summary(_latencies(spark, sf_dir), "latency_us", ["stream_id"])
    return summary.withColumn("mean_us", F.round("mean_us", 3))


@query("latency_bounded", f"""WITH {SQL_LATENCY}
SELECT stream_id, count(*) FILTER (v <= 60000000) AS count, max(v) FILTER (v <= 60000000) AS max_us,
  quantile_disc(v, 0.99) FILTER (v <= 60000000) AS p99_us, count(*) FILTER (v > 60000000) AS out_of_range
FROM ok GROUP BY stream_id""")
def latency_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies above a minute are told apart."""
    summary = metrics.latency_summary(_latencies(spark, sf_dir), "latency_us", ["stream_id"], 60_000_000)
    return summary.select("stream_id", "count", "max_us", "p99_us", "out_of_range")


@query("latency_histogram", f"""WITH {SQL_LATENCY}, {SQL_BUCKET} SELECT * FROM hist""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_histogram(_latencies(spark, sf_dir), "latency_us", ["stream_id"])


@query("histogram_quantiles", f"""WITH {SQL_LATENCY}, {SQL_BUCKET},
c AS (SELECT *, sum(rows) OVER (PARTITION BY stream_id ORDER BY bucket_low) AS upto,
  sum(rows) OVER (PARTITION BY stream_id) AS total FROM hist)
SELECT stream_id, min(bucket_high) FILTER (upto >= total * 0.5) AS p50_us,
  min(bucket_high) FILTER (upto >= total * 0.99) AS p99_us FROM c GROUP BY stream_id""")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles read off merged histograms of two shards."""
    rows = _latencies(spark, sf_dir).withColumn("shard", F.col("latency_us") % 2000)
    histogram = metrics.merge_histograms(
        metrics.latency_histogram(rows, "latency_us", ["shard", "stream_id"]), ["stream_id"]
    )
    return metrics.histogram_quantiles(histogram, ["stream_id"], {"p50_us": 0.5, "p99_us": 0.99})


SQL_SNAPSHOTS = f"""{sql_observations()},
tick AS (SELECT session_id, stream_id, us // {PERIOD} AS k, count(*) AS c, count(*) FILTER (value > 150) AS d,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS b FROM obs GROUP BY ALL),
snap AS (SELECT session_id, stream_id, (k + 1) * {PERIOD} AS at_us, CAST(sum(c) OVER w AS BIGINT) AS received,
  CAST(sum(d) OVER w AS BIGINT) AS dropped, CAST(sum(b) OVER w AS BIGINT) AS bytes FROM tick
  WINDOW w AS (PARTITION BY session_id, stream_id ORDER BY k))"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    counters = {
        "received": F.lit(1),
        "dropped": (F.col("value") > 150).cast("bigint"),
        "bytes": F.round(F.col("value") * 100).cast("bigint"),
    }
    rows = events(spark, sf_dir)
    ticks = span_bound(rows, "us", PERIOD)
    return metrics.snapshots(rows, PERIOD, counters, ticks), ticks


@query("snapshots", f"WITH {SQL_SNAPSHOTS} SELECT * FROM snap")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)[0]


@query("snapshot_rates", f"""WITH {SQL_SNAPSHOTS},
d AS (SELECT *, (at_us - lag(at_us) OVER w) / 1000000 AS secs, received - lag(received) OVER w AS dc,
  bytes - lag(bytes) OVER w AS db FROM snap WINDOW w AS (PARTITION BY session_id, stream_id ORDER BY at_us))
SELECT stream_id, at_us, secs AS window_secs, round(greatest(dc, 0) / secs, 9) AS received_per_sec,
  round(greatest(db, 0) / secs, 6) AS bytes_per_sec, round(greatest(db, 0) / secs * 8, 6) AS bytes_bits_per_sec FROM d""")
def snapshot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cumulative, ticks = _snapshots(spark, sf_dir)
    rates = metrics.rates(cumulative, ["received", "bytes"], size="bytes", tick_us=PERIOD, tick_bound=ticks)
    return rates.select(
        "stream_id", "at_us", "window_secs",
        F.round("received_per_sec", 9).alias("received_per_sec"),
        F.round("bytes_per_sec", 6).alias("bytes_per_sec"),
        F.round("bytes_bits_per_sec", 6).alias("bytes_bits_per_sec"),
    )


@query("utilisation", f"""WITH {SQL_SNAPSHOTS},
d AS (SELECT *, (at_us - lag(at_us) OVER w) / 1000000 AS secs, bytes - lag(bytes) OVER w AS db FROM snap
  WINDOW w AS (PARTITION BY session_id, stream_id ORDER BY at_us))
SELECT stream_id, at_us, round(greatest(db, 0) / 100.0 / secs, 6) AS cores,
  round(greatest(db, 0) / 100.0 / secs * 100.0 / 8, 4) AS percent_of_machine FROM d""")
def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte counter stands for CPU ticks at 100 per second on eight cores."""
    cumulative, ticks = _snapshots(spark, sf_dir)
    used = metrics.utilisation(cumulative.withColumnRenamed("at_us", "us"), "bytes", 100.0, 8, rows_bound=ticks)
    return used.select(
        "stream_id", F.col("us").alias("at_us"), F.round("cores", 6).alias("cores"),
        F.round("percent_of_machine", 4).alias("percent_of_machine"),
    )


@query("gauges", f"""WITH {sql_observations(SQL_USER)}, g AS (SELECT *, CAST(floor(value) AS BIGINT) AS used FROM obs)
SELECT session_id, stream_id, arg_max(used, (us, seq)) AS last_used, CAST(500 AS BIGINT) AS cap, max(used) AS max_used,
  arg_max(used, (us, seq)) / 500 AS last_fill, count(*) AS samples FROM g GROUP BY ALL""")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue fill per user and event type, capacity 500."""
    rows = user_events(spark, sf_dir).withColumn("used", F.floor("value")).withColumn("cap", F.lit(500).cast("bigint"))
    return metrics.gauge_statistics(rows, ["session_id", "stream_id"])


SQL_QUEUE = """q AS (SELECT epoch_us(ts) AS us, 1 AS delta, event_id AS seq FROM events UNION ALL
  SELECT epoch_us(ts) + ((event_id * 7919) % 7200) * 1000000, -1, event_id FROM events),
o AS (SELECT *, CAST(sum(delta) OVER (ORDER BY us, delta DESC, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inflight FROM q)"""


def _queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("session_id", "us", "arrival_us", "seq")
    offers = rows.select("session_id", "us", F.lit(1).alias("delta"), "seq")
    takes = rows.select("session_id", F.col("arrival_us").alias("us"), F.lit(-1).alias("delta"), "seq")
    return offers.unionByName(takes)


@query("occupancy", f"""WITH {SQL_QUEUE} SELECT us, delta, seq, inflight, inflight > 15 AS above FROM o""")
def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupied = metrics.occupancy(_queue_events(spark, sf_dir), 15)
    return occupied.select("us", "delta", "seq", "inflight", "above")


@query("occupancy_summary", f"""WITH {SQL_QUEUE}
SELECT 'all' AS session_id, count(*) FILTER (delta > 0) AS offers, max(inflight) AS max_inflight,
  count(*) FILTER (delta > 0 AND inflight > 15) AS offers_above FROM o""")
def occupancy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.occupancy_summary(metrics.occupancy(_queue_events(spark, sf_dir), 15))


@query("bounded_queue", """WITH q AS (
  SELECT epoch_us(ts) AS us, 1 AS delta, event_id AS seq FROM events UNION ALL
  SELECT epoch_us(ts) + 1000000, -1, event_id FROM events WHERE event_id % 4 = 0),
n AS (SELECT *, CAST(sum(delta) OVER (ORDER BY us, delta DESC, seq) AS BIGINT) AS s FROM q),
e AS (SELECT *, greatest(max(s - 500) OVER (ORDER BY us, delta DESC, seq), 0) AS overflow FROM n)
SELECT us, seq, delta, s - overflow AS length, overflow FROM e""")
def bounded_queue(spark: SparkSession, sf_dir: str, hot_rows: int | None = None) -> DataFrame:
    """All events are offered to a queue of 500, one in four is taken a second later; the newest is dropped."""
    offers = events(spark, sf_dir).select("session_id", "us", "seq", F.lit(1).alias("delta"))
    takes = offers.filter(F.col("seq") % 4 == 0).withColumn("us", F.col("us") + 1_000_000)
    occupied = metrics.occupancy(offers.unionByName(takes.withColumn("delta", F.lit(-1))), 500, hot_rows=hot_rows)
    return occupied.select("us", "seq", "delta", "length", "overflow")


@query("loss_rollup", f"""WITH {sql_observations(SQL_USER)},
l AS (SELECT session_id, CASE WHEN value > 250 THEN 'disk' WHEN value > 150 THEN 'queue' WHEN value > 100 THEN 'skipped'
  END AS cause FROM obs WHERE value > 100)
SELECT session_id, cause, count(*) AS lost, CAST(grouping(session_id, cause) AS BIGINT) AS level FROM l
GROUP BY ROLLUP (session_id, cause)""")
def loss_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    cause = F.when(value > 250, "disk").when(value > 150, "queue").otherwise("skipped")
    lost = user_events(spark, sf_dir).filter(value > 100).withColumn("cause", cause)
    return metrics.loss_rollup(lost.withColumn("lost", F.lit(1).cast("bigint")), "cause")


@query("run_rates", f"""WITH {sql_observations(SQL_USER)},
r AS (SELECT session_id, (max(us) - min(us)) / 1000000 AS wall_secs, count(*) AS received,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM obs GROUP BY session_id)
SELECT session_id, wall_secs, received, bytes, round(received / greatest(wall_secs, 1e-9), 9) AS received_per_sec,
  round(bytes / greatest(wall_secs, 1e-9), 6) AS bytes_per_sec FROM r""")
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = {"received": F.lit(1), "bytes": F.round(F.col("value") * 100)}
    rates = metrics.run_rates(user_events(spark, sf_dir), counters)
    return rates.withColumn("received_per_sec", F.round("received_per_sec", 9)).withColumn(
        "bytes_per_sec", F.round("bytes_per_sec", 6)
    )


@query("threshold_breaches", """WITH w AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity * 1000 AS BIGINT) AS elapsed FROM lineitem),
t AS (SELECT l_returnflag, l_linestatus, CAST(floor(avg(elapsed)) AS BIGINT) AS threshold_us FROM w GROUP BY ALL)
SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) FILTER (elapsed > threshold_us) AS breaches,
  coalesce(max(elapsed) FILTER (elapsed > threshold_us), 0) AS worst_us FROM w JOIN t USING (l_returnflag, l_linestatus)
GROUP BY ALL""")
def threshold_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for writes, quantity for milliseconds, the threshold is the group's mean."""
    by = ["l_returnflag", "l_linestatus"]
    writes = table(spark, sf_dir, "lineitem").select(
        *by, micros("l_shipdate").alias("us"), F.col("l_orderkey").alias("seq"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("elapsed_us"),
    )
    limits = writes.groupBy(*by).agg(F.floor(F.avg("elapsed_us")).alias("threshold_us"))
    return metrics.threshold_breaches(writes, limits, "elapsed_us", by)


@query("resource_peaks", f"""WITH {sql_observations(SQL_USER)}
SELECT session_id, max(value) AS peak, round(avg(CASE WHEN stream_id = 'error' AND value > 150 THEN value END), 6) AS mean_optional
FROM obs GROUP BY session_id""")
def resource_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    optional = F.when((F.col("stream_id") == "error") & (F.col("value") > 150), F.col("value"))
    rows = user_events(spark, sf_dir).withColumn("gpu", optional)
    return metrics.resource_peaks(rows, "value", "gpu", ["session_id"]).withColumn(
        "mean_optional", F.round("mean_optional", 6)
    )


@query("stream_counts", """SELECT CAST(user_id AS VARCHAR) AS session_id, count(DISTINCT event_type) AS streams
FROM events GROUP BY 1""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stream_counts(user_events(spark, sf_dir))


def _counters() -> dict:
    return {
        "received": F.lit(True),
        "dropped_queue": F.col("value") > 150,
        "audio_overrun": (F.col("stream_id") == "purchase") & (F.col("value") > 200),
        "disk_write_lag": F.col("value") > 250,
    }


@query("counter_board", f"""WITH {sql_observations(SQL_USER)}
SELECT session_id, count(*) AS received, count(*) FILTER (value > 150) AS dropped_queue,
  count(*) FILTER (stream_id = 'purchase' AND value > 200) AS audio_overrun,
  count(*) FILTER (value > 250) AS disk_write_lag FROM obs GROUP BY session_id""")
def counter_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_board(user_events(spark, sf_dir), _counters(), ["session_id"])


# --- verdict -------------------------------------------------------------------------------------------------------

TARGET = 5 * 1e6 / PERIOD

SQL_BOARD = f"""{sql_fill(PERIOD, 2, SQL_USER)},
c AS (SELECT session_id, count(*) AS received, count(*) FILTER (value > 150) AS dropped_queue,
  count(*) FILTER (stream_id = 'purchase' AND value > 200) AS audio_overrun, count(*) FILTER (value > 250) AS disk_write_lag,
  greatest((max(us) - min(us)) / 1000000, 1e-9) AS secs FROM obs GROUP BY session_id),
g AS (SELECT session_id, count(*) FILTER (status <> 'skipped') AS emitted, count(*) FILTER (status = 'filled') AS filled,
  CAST(sum(lost) AS BIGINT) AS skipped, count(*) FILTER (status = 'skipped') AS encoder_overload FROM filled GROUP BY session_id),
board AS (SELECT *, dropped_queue AS intake_overrun, dropped_queue + skipped AS lost, {TARGET!r} AS target,
  received / secs AS received_per_sec, emitted / secs AS emitted_per_sec,
  CAST(session_id AS BIGINT) % 2 = 0 AS hardware FROM c JOIN g USING (session_id))"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user session: counters of the input joined with counters of its slot log."""
    rows = user_events(spark, sf_dir)
    seen = rows.groupBy("session_id").agg(
        *[F.count_if(c).alias(name) for name, c in _counters().items()],
        F.greatest((F.max("us") - F.min("us")) / 1e6, F.lit(1e-9)).alias("secs"),
    )
    grid = regularise(rows, PERIOD, max_fill=2).groupBy("session_id").agg(
        F.count_if(F.col("status") != "skipped").alias("emitted"),
        F.count_if(F.col("status") == "filled").alias("filled"),
        F.sum("lost").alias("skipped"),
        F.count_if(F.col("status") == "skipped").alias("encoder_overload"),
    )
    board = seen.join(grid, "session_id").withColumns({
        "intake_overrun": F.col("dropped_queue"),
        "target": F.lit(TARGET),
        "received_per_sec": F.col("received") / F.col("secs"),
        "emitted_per_sec": F.col("emitted") / F.col("secs"),
        "hardware": F.col("session_id").cast("bigint") % 2 == 0,
    })
    return metrics.loss_accounting(board)


@query("verdict", f"""WITH {SQL_BOARD}
SELECT session_id, emitted, lost, round(emitted_per_sec, 9) AS emitted_per_sec,
  dropped_queue > 0 OR encoder_overload > 0 OR audio_overrun > 0 OR disk_write_lag > 0 AS any_overrun,
  emitted_per_sec >= target * 0.99 AND lost = 0 AS sustained, emitted_per_sec >= target * 0.97 AS summary_met FROM board""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdicts.verdict(_board(spark, sf_dir))
    return judged.select(
        "session_id", "emitted", "lost", F.round("emitted_per_sec", 9).alias("emitted_per_sec"), "any_overrun",
        "sustained", "summary_met",
    )


@query("diagnosis", f"""WITH {SQL_BOARD},
r AS (SELECT session_id, list_filter([
    CASE WHEN encoder_overload > 0 OR skipped > 0 THEN 'encoder_bottleneck' END,
    CASE WHEN (encoder_overload > 0 OR skipped > 0) AND NOT hardware THEN 'software_encoder' END,
    CASE WHEN (encoder_overload > 0 OR skipped > 0) AND hardware THEN 'lower_quality' END,
    CASE WHEN intake_overrun > 0 THEN 'intake_queue_overflow' END,
    CASE WHEN disk_write_lag > 0 THEN 'disk_lag' END,
    CASE WHEN received_per_sec < target * 0.95 AND lost = 0 THEN 'source_too_slow' END], lambda x : x IS NOT NULL) AS l FROM board),
d AS (SELECT session_id, CASE WHEN len(l) = 0 THEN ['source_limited_default'] ELSE l END AS l FROM r)
SELECT session_id, CAST(unnest(range(len(l))) AS INTEGER) AS position, unnest(l) AS cause FROM d""")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.diagnosis_rows(verdicts.diagnosis(_board(spark, sf_dir)))


@query("fault_rows", f"""WITH {SQL_BOARD},
w AS (SELECT session_id, lost, intake_overrun, encoder_overload, audio_overrun, disk_write_lag FROM board)
SELECT * FROM (UNPIVOT w ON lost, intake_overrun, encoder_overload, audio_overrun, disk_write_lag INTO NAME counter VALUE value)
WHERE value > 0""")
def fault_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = ["lost", "intake_overrun", "encoder_overload", "audio_overrun", "disk_write_lag"]
    return verdicts.fault_rows(_board(spark, sf_dir), ["session_id"], counters)


@query("dashboard", f"""WITH {SQL_BOARD},
lat AS (SELECT {SQL_USER} AS session_id, event_type AS stage, greatest({LATENCY}, 1) AS v FROM events),
s AS (SELECT session_id, {", ".join(f"max(v) FILTER (stage = '{x}') AS {x}_max_us, "
  f"quantile_disc(v, 0.99) FILTER (stage = '{x}') AS {x}_p99_us" for x in STAGES)} FROM lat GROUP BY session_id)
SELECT session_id, received, emitted, lost, filled, s.* EXCLUDE (session_id) FROM board LEFT JOIN s USING (session_id)""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and the latencies of all stages side by side."""
    rows = table(spark, sf_dir, "events").select(
        F.expr(USER_SESSION).alias("session_id"), F.col("event_type").alias("stage"), F.expr(LATENCY).alias("latency_us")
    )
    summary = metrics.latency_summary(rows, "latency_us", ["session_id", "stage"])
    stages = metrics.stage_columns(summary, "session_id", "stage", STAGES, ["max_us", "p99_us"])
    board = _board(spark, sf_dir).select("session_id", "received", "emitted", "lost", "filled")
    return board.join(stages, "session_id", "left")


# --- planning and rules --------------------------------------------------------------------------------------------

SQL_PICK = """req AS (SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'av1' END AS codec,
  CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'very_high' END AS quality,
  CASE p_size % 3 WHEN 0 THEN 'vbr' WHEN 1 THEN 'cbr' ELSE 'cq' END AS rate_control,
  CAST(p_size AS BIGINT) * 77 AS width, CAST(p_size AS BIGINT) * 43 AS height, 30 + p_partkey % 2 * 30 AS fps,
  CASE WHEN p_partkey % 10 = 0 THEN 35000000 ELSE 0 END AS bitrate,
  CASE (p_partkey // 3) % 4 WHEN 0 THEN 'intel' WHEN 1 THEN 'amd' WHEN 2 THEN 'nvidia' ELSE 'other' END AS vendor,
  CASE (p_partkey // 12) % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'force' ELSE 'off' END AS policy,
  CASE p_partkey % 20 WHEN 7 THEN 'hevc_qsv' WHEN 13 THEN 'vp9_qsv' ELSE '' END AS forced_name FROM part)"""


def _pick(key, names: list[str]):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key + 1).cast("int"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    forced = F.when(key % 20 == 7, "hevc_qsv").when(key % 20 == 13, "vp9_qsv").otherwise("")
    return table(spark, sf_dir, "part").select(
        key.alias("request_id"),
        _pick(key % 3, ["h264", "hevc", "av1"]).alias("codec"),
        _pick(key % 4, ["low", "medium", "high", "very_high"]).alias("quality"),
        _pick(size % 3, ["vbr", "cbr", "cq"]).alias("rate_control"),
        (size * 77).alias("width"),
        (size * 43).alias("height"),
        (key % 2 * 30 + 30).alias("fps"),
        F.when(key % 10 == 0, 35_000_000).otherwise(0).cast("bigint").alias("bitrate"),
        _pick(scalars.int_div(key, 3) % 4, ["intel", "amd", "nvidia", "other"]).alias("vendor"),
        _pick(scalars.int_div(key, 12) % 3, ["auto", "force", "off"]).alias("policy"),
        forced.alias("forced_name"),
    )


@query("bitrate_plan", f"""WITH {SQL_PICK},
b AS (SELECT *, CASE WHEN bitrate > 0 THEN bitrate ELSE CAST(least(greatest(trunc(
  CAST(width AS DOUBLE) * CAST(height AS DOUBLE) * CAST(fps AS DOUBLE)
  * CASE quality WHEN 'low' THEN 0.035::DOUBLE WHEN 'medium' THEN 0.07::DOUBLE WHEN 'high' THEN 0.12::DOUBLE ELSE 0.2::DOUBLE END
  * CASE codec WHEN 'h264' THEN 1.0::DOUBLE WHEN 'hevc' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END), 1000000), 200000000) AS BIGINT) END AS p FROM req)
SELECT request_id, p AS planned_bitrate, CASE rate_control WHEN 'vbr' THEN CAST(trunc(p * 1.5::DOUBLE) AS BIGINT) WHEN 'cbr' THEN p END AS max_bitrate,
  CASE WHEN rate_control = 'cq' THEN CASE quality WHEN 'low' THEN 32 WHEN 'medium' THEN 27 WHEN 'high' THEN 23 ELSE 19 END END AS quantiser,
  width // 2 * 2 AS even_width, height // 2 * 2 AS even_height, width // 2 * 2 >= 16 AND height // 2 * 2 >= 16 AS size_ok FROM b""")
def bitrate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_bitrate(_requests(spark, sf_dir)).select(
        "request_id", "planned_bitrate", "max_bitrate", "quantiser", "even_width", "even_height", "size_ok"
    )


SQL_RANKED = f"""{SQL_PICK},
pref AS (SELECT * FROM (VALUES ('intel', 1, 'vaapi'), ('intel', 2, 'qsv'), ('amd', 1, 'vaapi'), ('amd', 2, 'amf'),
  ('nvidia', 1, 'nvenc'), ('nvidia', 2, 'vaapi'), ('other', 1, 'vaapi'), ('other', 2, 'qsv'), ('other', 3, 'nvenc'),
  ('other', 4, 'amf')) AS t(vendor, pos, iface)),
soft AS (SELECT * FROM (VALUES ('h264', 1, 'libx264'), ('hevc', 1, 'libx265'), ('av1', 1, 'libsvtav1'), ('av1', 2, 'librav1e'),
  ('av1', 3, 'libaom-av1')) AS t(codec, pos, name)),
fam AS (SELECT * FROM (VALUES ('h264', 1), ('hevc', 2), ('av1', 3)) AS t(fcodec, fpos)),
free AS (SELECT * FROM req WHERE forced_name = ''),
every AS (
  SELECT request_id, codec || '_' || iface AS name, codec AS cc, pos AS ord FROM free JOIN pref USING (vendor) WHERE policy <> 'off'
  UNION ALL SELECT request_id, fcodec || '_' || iface, fcodec, fpos * 10 + pos FROM free JOIN pref USING (vendor), fam WHERE policy <> 'off'
  UNION ALL SELECT request_id, name, soft.codec, 100 + pos FROM free JOIN soft USING (codec) WHERE policy <> 'force'
  UNION ALL SELECT request_id, 'libx264', 'h264', 200 FROM free WHERE policy <> 'force'),
once AS (SELECT request_id, name, cc, min(ord) AS ord FROM every GROUP BY ALL),
ranked AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY ord) AS INTEGER) AS rank, name, cc AS candidate_codec,
  CASE WHEN name LIKE '%vaapi' OR name LIKE '%qsv' THEN 'hw_frames' WHEN name LIKE 'lib%' THEN 'software' ELSE 'hw_direct' END AS class FROM once
  UNION ALL SELECT request_id, 1, CASE WHEN forced_name = 'hevc_qsv' THEN forced_name ELSE '?' END,
  CASE WHEN forced_name = 'hevc_qsv' THEN 'hevc' ELSE codec END, 'hw_frames' FROM req WHERE forced_name <> '')"""


@query("ranked_candidates", f"WITH {SQL_RANKED} SELECT * FROM ranked")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.rank_candidates(_requests(spark, sf_dir))


@query("first_success", f"""WITH {SQL_RANKED},
a AS (SELECT *, (request_id * 31 + rank * 17) % 5 = 0 AS ok FROM ranked),
b AS (SELECT request_id, min(rank) FILTER (ok) AS best, arg_min(name, rank) FILTER (ok) AS name,
  arg_min(candidate_codec, rank) FILTER (ok) AS opened_codec FROM a GROUP BY request_id)
SELECT request_id, best AS rank, b.name, best IS NOT NULL AS opened, opened_codec <> codec AS fallback,
  coalesce((SELECT string_agg(a.name || ' (errno ' || (a.rank % 7) || ')', ', ' ORDER BY a.rank) FROM a
    WHERE a.request_id = b.request_id AND NOT ok AND (best IS NULL OR a.rank < best)), '') AS failures
FROM b JOIN req USING (request_id)""")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth attempt opens."""
    requests = _requests(spark, sf_dir)
    ranked = planning.rank_candidates(requests).join(requests.select("request_id", "codec"), "request_id")
    attempts = ranked.withColumn("ok", (F.col("request_id") * 31 + F.col("rank") * 17) % 5 == 0).withColumn(
        "err", F.format_string("errno %d", F.col("rank") % 7)
    )
    return planning.first_success(attempts).withColumn("failures", F.concat_ws(", ", "failures"))


SQL_CONFIG = """cfg AS (SELECT p_partkey AS config_id, p_partkey % 500 AS fps, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey * 1000 END AS vb,
  p_size / 2.0::DOUBLE * 3 AS kf, p_size % 20 AS bf, p_partkey AS la, p_size * 2 AS ct,
  CASE WHEN p_partkey % 5 = 0 THEN 'off' ELSE 'auto' END AS hw, CASE WHEN p_partkey % 2 = 0 THEN 'h264_vaapi' ELSE '' END AS enc,
  p_partkey % 4 <> 0 AS audio, CASE p_partkey % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 96000 END AS sr, p_size % 4 AS ch,
  CAST(p_size AS BIGINT) * 12000 AS ab, p_size * 3 AS fm, p_partkey * 4 AS md, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS path,
  p_partkey % 17 <> 0 AS folder, p_partkey * 3 AS wb, p_size * 6 AS vq, p_partkey * 3 AS aq, p_partkey * 5 AS pq, p_size * 5 + 20 AS fp FROM part)"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("config_id"),
        (key % 500).alias("video_fps"),
        F.when(key % 9 == 0, 0).otherwise(key * 1000).alias("video_bitrate"),
        (size / 2.0 * 3).alias("video_keyframe_secs"),
        (size % 20).alias("video_b_frames"),
        key.alias("video_lookahead_ms"),
        (size * 2).alias("video_convert_threads"),
        F.when(key % 5 == 0, "off").otherwise("auto").alias("video_hardware"),
        F.when(key % 2 == 0, "h264_vaapi").otherwise("").alias("video_encoder"),
        (key % 4 != 0).alias("audio_enabled"),
        F.when(key % 3 == 0, 48_000).when(key % 3 == 1, 44_100).otherwise(96_000).alias("audio_sample_rate"),
        (size % 4).alias("audio_channels"),
        (size.cast("bigint") * 12_000).alias("audio_bitrate"),
        (size * 3).alias("audio_fragment_ms"),
        (key * 4).alias("audio_max_drift_ms"),
        F.when(key % 50 == 0, "").otherwise(F.col("p_name")).alias("output_path"),
        (key % 17 != 0).alias("output_folder_exists"),
        (key * 3).alias("output_buffer_kb"),
        (size * 6).alias("queue_video"),
        (key * 3).alias("queue_audio"),
        (key * 5).alias("queue_packet"),
        (size * 5 + 20).alias("frame_pool"),
    )


@query("rule_violations", f"""WITH {SQL_CONFIG} SELECT config_id, rule FROM (
SELECT config_id, unnest(list_filter([
  CASE WHEN NOT fps BETWEEN 1 AND 480 THEN 'fps_bounds' END, CASE WHEN fps < 30 THEN 'fps_minimum' END,
  CASE WHEN vb <> 0 AND NOT vb BETWEEN 100000 AND 500000000 THEN 'video_bitrate' END,
  CASE WHEN NOT kf BETWEEN 0.1 AND 60 THEN 'keyframe_interval' END, CASE WHEN bf > 16 THEN 'b_frames' END,
  CASE WHEN la > 1000 THEN 'lookahead' END, CASE WHEN ct > 64 THEN 'convert_threads' END,
  CASE WHEN hw = 'off' AND enc LIKE '%vaapi%' THEN 'hardware_off' END, CASE WHEN audio AND sr = 96000 THEN 'sample_rate' END,
  CASE WHEN audio AND NOT ch BETWEEN 1 AND 2 THEN 'channels' END,
  CASE WHEN audio AND NOT ab BETWEEN 32000 AND 512000 THEN 'audio_bitrate' END,
  CASE WHEN audio AND NOT fm BETWEEN 1 AND 100 THEN 'fragment' END,
  CASE WHEN audio AND NOT md BETWEEN 10 AND 5000 THEN 'max_drift' END, CASE WHEN path = '' THEN 'path_empty' END,
  CASE WHEN NOT folder THEN 'folder_missing' END, CASE WHEN NOT wb BETWEEN 64 AND 262144 THEN 'writer_buffer' END,
  CASE WHEN NOT vq BETWEEN 2 AND 240 THEN 'video_queue' END, CASE WHEN NOT aq BETWEEN 2 AND 4096 THEN 'audio_queue' END,
  CASE WHEN NOT pq BETWEEN 8 AND 8192 THEN 'packet_queue' END, CASE WHEN fp < vq + 2 THEN 'frame_pool' END
], lambda x : x IS NOT NULL)) AS rule FROM cfg)""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = rules.validate(_configs(spark, sf_dir), rules.config_rules())
    return rules.violation_rows(validated, ["config_id"]).select("config_id", "rule")


@query("layered_overrides", """WITH cli AS (SELECT o_custkey AS k, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
f AS (SELECT o_custkey AS k, max(o_orderpriority) AS p, max(o_orderstatus) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT c_custkey, coalesce(cli.p, f.p, '3-MEDIUM') AS priority, coalesce(f.s, '?') AS status
FROM customer LEFT JOIN cli ON cli.k = c_custkey LEFT JOIN f ON f.k = c_custkey""")
def layered_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders override open ones, which override the defaults."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    strong = orders.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(
        F.max("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("status")
    )
    weak = orders.filter("o_orderstatus <> 'F'").groupBy("c_custkey").agg(
        F.max("o_orderpriority").alias("priority"), F.max("o_orderstatus").alias("status")
    )
    defaults = {"priority": "3-MEDIUM", "status": "?"}
    return rules.layered_overrides(table(spark, sf_dir, "customer"), "c_custkey", [weak, strong], defaults)
