"""Regularisation: grid, late rows, variable rate, caps, origin, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.operators import align, audit, grid, origin
from streamgrid.operators.joins import lookup_join
from streamgrid.plans.inputs import (
    DAY,
    FINE,
    HOUR,
    events,
    sql_fill,
    sql_observations,
    sql_origin,
    sql_slots,
    user_events,
)
from streamgrid.plans.registry import query
from streamgrid.plans.regularise import anchored, regularise, slotted, slotted_with_bound

SQL_USER = "CAST(user_id AS VARCHAR)"


@query("grid_fill", f"""WITH {sql_fill(HOUR)}
SELECT stream_id, slot, us, value, status, superseded FROM filled""")
def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: hourly grid per event type from the latest first event, last value wins, gaps repeated."""
    return regularise(events(spark, sf_dir), HOUR).select("stream_id", "slot", "us", "value", "status", "superseded")


@query("grid_fill_by_user", f"""WITH {sql_fill(6 * HOUR, None, SQL_USER)}
SELECT session_id, stream_id, slot, us, value, status FROM filled""")
def grid_fill_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one session per user."""
    filled = regularise(user_events(spark, sf_dir), 6 * HOUR)
    return filled.select("session_id", "stream_id", "slot", "us", "value", "status")


@query("grid_fill_bounded", f"""WITH {sql_fill(FINE, 2)}
SELECT stream_id, slot, slot_to, status, us, value, CAST(lost AS BIGINT) AS lost FROM filled""")
def grid_fill_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = regularise(events(spark, sf_dir), FINE, max_fill=2)
    return filled.select("stream_id", "slot", "slot_to", "status", "us", "value", "lost")


@query("grid_status_counts", f"""WITH {sql_fill(FINE, 2)}
SELECT session_id, stream_id, count(*) FILTER (status = 'fresh') AS fresh,
  count(*) FILTER (status = 'filled') AS filled, CAST(sum(lost) AS BIGINT) AS skipped,
  CAST(sum(superseded) AS BIGINT) AS superseded, CAST(0 AS BIGINT) AS late,
  count(*) FILTER (status = 'skipped') AS overloads, CAST(sum(slot_to - slot + 1) AS BIGINT) AS slots
FROM filled GROUP BY session_id, stream_id""")
def grid_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.status_counts(regularise(events(spark, sf_dir), FINE, max_fill=2))


@query("grid_anchor_first", f"""WITH {sql_origin()},
a AS (SELECT *, min(us) OVER (PARTITION BY session_id, stream_id) AS anchor_us FROM kept)
SELECT stream_id, (us - anchor_us + {FINE // 2}) // {FINE} AS slot, max(us) AS us, count(*) - 1 AS superseded
FROM a GROUP BY 1, 2""")
def grid_anchor_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot 0 at the first kept row of each stream."""
    return slotted(events(spark, sf_dir), FINE, anchor="first").select("stream_id", "slot", "us", "superseded")


@query("late_reslot", f"""WITH {sql_slots(HOUR)},
eff AS (
  SELECT *, greatest(slot, CAST(ceil((arrival_us - t0 - {HOUR // 2}) / {HOUR}.0) AS BIGINT)) AS e FROM slotted)
SELECT stream_id, e AS slot, arg_max(seq, (arrival_us, us, seq)) AS seq, arg_max(value, (arrival_us, us, seq)) AS value,
  count(*) - 1 AS superseded, count(*) FILTER (e > slot) AS late
FROM eff GROUP BY stream_id, e""")
def late_reslot(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = slotted(events(spark, sf_dir), HOUR, lookahead_us=HOUR // 2)
    return late.select("stream_id", "slot", "seq", "value", "superseded", "late")


@query("vfr_thin", f"""WITH {sql_origin()},
t AS (SELECT stream_id, seq, us - t0 AS tick,
  max(us - t0) OVER (PARTITION BY stream_id ORDER BY arrival_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS latest FROM kept)
SELECT stream_id, seq, tick FROM t WHERE latest IS NULL OR tick > latest""")
def vfr_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.monotonic_thin(anchored(events(spark, sf_dir))).select("stream_id", "seq", "tick")


@query("event_cap", f"""WITH {sql_observations()}
SELECT stream_id, seq, us FROM obs QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY us, seq) <= 25""")
def event_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cap_rows(events(spark, sf_dir), 25).select("stream_id", "seq", "us")


@query("duration_cap", f"""WITH {sql_origin()} SELECT stream_id, seq, us FROM kept WHERE us < t0 + {7 * DAY}""")
def duration_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cap_duration(anchored(events(spark, sf_dir)), 7 * DAY).select("stream_id", "seq", "us")


@query("common_origin", f"WITH {sql_origin()} SELECT session_id, t0, streams FROM origin")
def common_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.common_origin(events(spark, sf_dir))


@query("origin_with_timeout", f"""WITH {sql_observations(SQL_USER)},
firsts AS (SELECT session_id, stream_id, min(us) AS f FROM obs GROUP BY ALL),
part AS (SELECT * FROM firsts WHERE NOT (stream_id = 'error' AND CAST(session_id AS BIGINT) % 2 = 0)),
base AS (SELECT session_id, min(f) AS e FROM part GROUP BY session_id)
SELECT session_id, max(f) AS t0, count(*) AS streams FROM part JOIN base USING (session_id)
WHERE f <= e + {2 * DAY} GROUP BY session_id""")
def origin_with_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error streams of users with an even number withdraw; streams later than two days do not decide."""
    rows = user_events(spark, sf_dir)
    withdrawn = rows.filter((F.col("stream_id") == "error") & (F.col("session_id").cast("bigint") % 2 == 0))
    return origin.common_origin(rows, withdrawn=withdrawn, timeout_us=2 * DAY)


@query("pre_origin_counts", f"""WITH {sql_origin(SQL_USER)}
SELECT session_id, stream_id, count(*) FILTER (us < t0) AS pre_origin, count(*) FILTER (us >= t0) AS kept
FROM obs JOIN origin USING (session_id) GROUP BY ALL""")
def pre_origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_events(spark, sf_dir)
    return origin.pre_origin_counts(origin.attach_origin(rows, origin.common_origin(rows)))


@query("missing_slots", f"""WITH {sql_slots(FINE)}
SELECT slot, us, value FROM coalesced a WHERE stream_id = 'click'
  AND NOT EXISTS (SELECT 1 FROM coalesced b WHERE b.stream_id = 'view' AND b.slot = a.slot)""")
def missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = slotted(events(spark, sf_dir), FINE)
    return align.missing_slots(slots, "click", "view").select("slot", "us", "value")


@query("shared_slots", f"""WITH {sql_slots(FINE)}
SELECT slot, us, value FROM coalesced a WHERE stream_id = 'click'
  AND EXISTS (SELECT 1 FROM coalesced b WHERE b.stream_id = 'view' AND b.slot = a.slot)""")
def shared_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = slotted(events(spark, sf_dir), FINE)
    return align.shared_slots(slots, "click", "view").select("slot", "us", "value")


@query("extent_agreement", f"""WITH {sql_observations(SQL_USER)},
x AS (SELECT session_id, stream_id, min(us) AS s, max(us) AS e FROM obs GROUP BY ALL)
SELECT session_id, count(*) AS streams, max(s) - min(s) AS start_gap_us, max(e - s) - min(e - s) AS length_gap_us,
  max(s) - min(s) < {2 * DAY} AS starts_agree, max(e - s) - min(e - s) < {4 * DAY} AS lengths_agree
FROM x GROUP BY session_id""")
def extent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.compare_extents(align.stream_extents(user_events(spark, sf_dir)), 2 * DAY, 4 * DAY)


@query("covered_rows", f"""WITH {sql_observations(SQL_USER)},
x AS (SELECT session_id, stream_id, min(us) AS s, max(us) AS e FROM obs GROUP BY ALL),
c AS (SELECT session_id, max(s) AS f, min(e) AS t FROM x GROUP BY session_id)
SELECT session_id, stream_id, count(*) AS rows FROM obs JOIN c USING (session_id) WHERE us BETWEEN f AND t GROUP BY ALL""")
def covered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inside the period all streams of a session cover."""
    rows = user_events(spark, sf_dir)
    period = align.covered_period(align.stream_extents(rows))
    inside = lookup_join(rows, period, ["session_id"], spread_by=["stream_id", "seq"]).filter(
        align.within(F.col("us"), F.col("from_us"), F.col("to_us"))
    )
    return inside.groupBy("session_id", "stream_id").agg(F.count(F.lit(1)).alias("rows"))


@query("start_check", f"""WITH {sql_slots(HOUR)}
SELECT session_id, stream_id, min(slot) AS first, min(slot) BETWEEN 0 AND 1 AS start_ok FROM coalesced GROUP BY ALL""")
def start_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.start_check(slotted(events(spark, sf_dir), HOUR), "slot", 0, 1)


@query("grid_check", f"""WITH {sql_fill(FINE, 2)},
g AS (SELECT *, lag(slot) OVER (PARTITION BY stream_id ORDER BY slot) AS p FROM filled WHERE status <> 'skipped')
SELECT session_id, stream_id, count(p) AS intervals, count(*) FILTER (slot - p <> 1) AS irregular,
  count(*) FILTER (slot - p <> 1) = 0 AS grid_ok FROM g GROUP BY ALL""")
def grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped runs leave irregular intervals behind; filled ones do not."""
    slots, limit = slotted_with_bound(events(spark, sf_dir), FINE)
    filled = grid.fill_gaps(slots, max_fill=2, slot_bound=limit).filter("status <> 'skipped'")
    return audit.grid_check(filled, F.col("slot") * FINE, FINE, 1000, slot_bound=limit)


@query("rate_check", f"""WITH {sql_fill(HOUR)},
r AS (SELECT session_id, stream_id, count(*) AS rows,
  CAST(round((max(slot) - min(slot)) * {HOUR} / {HOUR}.0) AS BIGINT) + 1 AS expected_rows FROM filled GROUP BY ALL)
SELECT *, abs(rows - expected_rows) <= 4 AS rate_ok FROM r""")
def rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = regularise(events(spark, sf_dir), HOUR).withColumn("us", F.col("slot") * HOUR)
    return audit.rate_check(filled, HOUR, 4)


@query("observed_rate_check", f"""WITH {sql_observations()},
r AS (SELECT session_id, stream_id, count(*) / ((max(us) - min(us)) / 1e6) AS rate FROM obs GROUP BY ALL)
SELECT session_id, stream_id, round(rate * 3600, 4) AS per_hour, abs(rate - 1 / 1300.0) < 2e-5 AS rate_ok FROM r""")
def observed_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = audit.observed_rate_check(events(spark, sf_dir), 1 / 1300.0, 2e-5)
    return checked.select("session_id", "stream_id", F.round(F.col("rate") * 3600, 4).alias("per_hour"), "rate_ok")


@query("conservation", f"""WITH {sql_fill(6 * HOUR, 2, SQL_USER)},
seen AS (SELECT session_id, stream_id, count(*) AS observations, count(*) FILTER (us < t0) AS pre_origin,
  count(*) FILTER (session_id IS NULL OR stream_id IS NULL OR us IS NULL OR t0 IS NULL) AS rejected
  FROM obs LEFT JOIN origin USING (session_id) GROUP BY ALL),
g AS (SELECT session_id, stream_id, count(*) FILTER (status = 'fresh') AS fresh,
  count(*) FILTER (status = 'filled') AS filled, CAST(sum(lost) AS BIGINT) AS skipped,
  CAST(sum(superseded) AS BIGINT) AS superseded, max(slot_to) - min(slot) + 1 AS slots FROM filled GROUP BY ALL),
b AS (SELECT session_id, stream_id, observations, pre_origin, rejected, coalesce(fresh, 0) AS fresh, coalesce(filled, 0) AS filled,
  coalesce(skipped, 0) AS skipped, coalesce(superseded, 0) AS superseded, coalesce(slots, 0) AS slots
  FROM seen LEFT JOIN g USING (session_id, stream_id))
SELECT *, observations = fresh + superseded + pre_origin + rejected AS rows_conserved,
  slots = fresh + filled + skipped AS slots_conserved FROM b""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_events(spark, sf_dir)
    seen = origin.attach_origin(rows, origin.common_origin(rows), "left")
    return audit.conservation(seen, regularise(rows, 6 * HOUR, max_fill=2))
