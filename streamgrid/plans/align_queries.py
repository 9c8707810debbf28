"""As-of state, drift, correction, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.operators import align, blocks, drift
from streamgrid.operators.joins import lookup_join
from streamgrid.plans.inputs import (
    DAY,
    HOUR,
    events,
    sql_observations,
    sql_origin,
    units_of,
    vector_chunks,
)
from streamgrid.plans.registry import query
from streamgrid.plans.regularise import anchored

# A counted clock for ``events``: units per 30 days, and the gap in units above which drift is not smoothed.
RATE, TB_US, MAX_GAP = 4000, 30 * DAY, 60


def _sql_units(elapsed: str) -> str:
    """Truncated units of a time span, split like the engine to stay in BIGINT."""
    return f"(({elapsed}) // {TB_US}) * {RATE} + ((({elapsed}) - (({elapsed}) // {TB_US}) * {TB_US}) * {RATE}) // {TB_US}"


def _sql_us(units: str) -> str:
    return f"(({units}) // {RATE}) * {TB_US} + ((({units}) - (({units}) // {RATE}) * {RATE}) * {TB_US}) // {RATE}"


SQL_COUNTED = f"""{sql_origin()},
counted AS (SELECT session_id, stream_id, seq, us, t0 AS anchor_us, 1 + seq % 3 AS units,
  CAST(coalesce(sum(1 + seq % 3) OVER (PARTITION BY stream_id ORDER BY us, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS counted FROM kept),
drifted AS (SELECT *, {_sql_units('us - anchor_us')} AS expected, {_sql_units('us - anchor_us')} - counted AS drift,
  anchor_us + {_sql_us('counted')} AS media_us FROM counted),
timed AS (SELECT *, {_sql_us('drift')} AS drift_us FROM drifted)"""


def _drifted(spark: SparkSession, sf_dir: str, rows_bound: int | None = None) -> DataFrame:
    rows = anchored(events(spark, sf_dir)).withColumn("units", units_of()).withColumn("anchor_us", F.col("t0"))
    return drift.drift(drift.counted_pts(rows, rows_bound=rows_bound), RATE, tb_us=TB_US)


@query("asof_latest", f"""WITH {sql_observations()},
u AS (SELECT us, 0 AS side, seq, value AS l, NULL AS r FROM obs WHERE stream_id = 'click'
  UNION ALL SELECT us, 1, seq, NULL, value FROM obs WHERE stream_id = 'view')
SELECT us, side, seq, last_value(l IGNORE NULLS) OVER w AS latest_left, last_value(r IGNORE NULLS) OVER w AS latest_right
FROM u WINDOW w AS (ORDER BY us, side, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    both = align.asof_latest(rows.filter("stream_id = 'click'"), rows.filter("stream_id = 'view'"))
    return both.select("us", "side", "seq", "latest_left", "latest_right")


@query("relative_drift", f"""WITH {SQL_COUNTED},
l AS (SELECT stream_id, us, seq, us - anchor_us AS elapsed, (media_us - anchor_us) - (us - anchor_us) AS lead FROM timed),
u AS (SELECT us, 0 AS side, seq, elapsed, lead AS a, NULL AS b FROM l WHERE stream_id = 'purchase'
  UNION ALL SELECT us, 1, seq, elapsed, NULL, lead FROM l WHERE stream_id = 'signup'),
g AS (SELECT *, last_value(b IGNORE NULLS) OVER w - last_value(a IGNORE NULLS) OVER w AS gap_us FROM u
  WINDOW w AS (ORDER BY us, side, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, first_value(CASE WHEN elapsed >= {DAY} THEN gap_us END IGNORE NULLS) OVER (ORDER BY us, side, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS baseline_us FROM g)
SELECT us, side, seq, gap_us, baseline_us,
  CASE WHEN gap_us IS NULL THEN NULL WHEN baseline_us IS NULL THEN 0 ELSE gap_us - baseline_us END AS drift_us FROM f""")
def relative_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = events(spark, sf_dir).count()
    rows = drift.leads(_drifted(spark, sf_dir, total)).withColumn("elapsed_us", F.col("us") - F.col("t0"))
    left, right = rows.filter("stream_id = 'purchase'"), rows.filter("stream_id = 'signup'")
    out = drift.relative_drift(left, right, warmup_us=DAY, rows_bound=total)
    return out.select("us", "side", "seq", "gap_us", "baseline_us", "drift_us")


@query("counted_pts", f"""WITH {SQL_COUNTED} SELECT stream_id, seq, counted, media_us FROM timed""")
def counted_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drifted(spark, sf_dir).select("stream_id", "seq", "counted", "media_us")


@query("drift_plan", f"""WITH {SQL_COUNTED},
a AS (SELECT *, greatest(least(drift // 8, {RATE // 100}), -{RATE // 100}) AS soft FROM timed)
SELECT stream_id, seq, drift, drift_us, CASE WHEN abs(drift) < {RATE // 1000} THEN 'none' WHEN drift > {MAX_GAP} THEN 'insert'
  WHEN -drift > {MAX_GAP} THEN 'drop' WHEN soft = 0 THEN 'none' ELSE 'compensate' END AS action,
  CASE WHEN abs(drift) < {RATE // 1000} THEN 0 WHEN drift > {MAX_GAP} THEN drift
  WHEN -drift > {MAX_GAP} THEN -drift ELSE soft END AS amount FROM a""")
def drift_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = drift.plan_correction(_drifted(spark, sf_dir), RATE, MAX_GAP)
    return planned.select("stream_id", "seq", "drift", "drift_us", "action", "amount")


@query("clock_check", f"""WITH {SQL_COUNTED},
c AS (SELECT session_id, stream_id, {_sql_us('max(counted)')} AS media_us, max(us) - min(anchor_us) AS wall_us,
  max(abs(drift_us)) AS max_drift_us FROM timed GROUP BY ALL)
SELECT *, abs(media_us - wall_us) < {DAY} AS clock_ok, max_drift_us < {DAY} AS drift_ok FROM c""")
def clock_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.clock_check(_drifted(spark, sf_dir), RATE, DAY, DAY, tb_us=TB_US)


def sql_clock(t0: str, closed_loop: bool = False, session: str = "'all'") -> str:
    """CTEs b (blocks with skipped and expected units) and step (the clock, block by block); ``t0`` of a session's rows."""
    soft = f"greatest(least(drift // 8, {RATE // 100}), -{RATE // 100})" if closed_loop else "0"
    return f"""{sql_observations(session)},
firsts AS (SELECT session_id, stream_id, min(us) AS us, min(min(us)) OVER (PARTITION BY session_id) AS earliest
  FROM obs GROUP BY session_id, stream_id),
origin AS (SELECT session_id, {t0} AS t0 FROM firsts GROUP BY session_id),
a AS (SELECT session_id, stream_id, us, seq, us - t0 AS start, 1 + seq % 3 AS n,
  least(greatest({_sql_units('t0 - us')}, 0), 1 + seq % 3) AS skipped FROM obs JOIN origin USING (session_id)),
b AS (SELECT *, {_sql_units(f"start + {_sql_us('skipped')}")} AS expected FROM a),
live AS (SELECT *, n - skipped AS m, row_number() OVER (PARTITION BY session_id, stream_id ORDER BY us, seq) AS rn
  FROM b WHERE skipped < n),
step AS (
  SELECT session_id, stream_id, rn, seq, expected, m, CAST(0 AS BIGINT) AS counted, expected AS drift FROM live WHERE rn = 1
  UNION ALL
  SELECT l.session_id, l.stream_id, l.rn, l.seq, l.expected, l.m, c.next, l.expected - c.next
  FROM (SELECT *, CASE WHEN abs(drift) < {RATE // 1000} THEN counted + m WHEN drift > {MAX_GAP} THEN counted + drift + m
          WHEN -drift > {MAX_GAP} THEN counted + m - least(-drift, m) ELSE counted + m + {soft} END AS next FROM step) c
  JOIN live l ON l.session_id = c.session_id AND l.stream_id = c.stream_id AND l.rn = c.rn + 1)"""


def sql_correction(t0: str, closed_loop: bool = False, session: str = "'all'") -> str:
    """All blocks with what is done to them."""
    return f"""WITH RECURSIVE {sql_clock(t0, closed_loop, session)},
act AS (SELECT *, greatest(least(drift // 8, {RATE // 100}), -{RATE // 100}) AS soft FROM step)
SELECT b.session_id, b.stream_id, b.seq, b.skipped, counted,
  CASE WHEN counted IS NULL THEN 'trimmed' WHEN abs(drift) < {RATE // 1000} THEN 'none' WHEN drift > {MAX_GAP} THEN 'insert'
    WHEN -drift > {MAX_GAP} THEN 'drop' WHEN soft = 0 THEN 'none' ELSE 'compensate' END AS action,
  CASE WHEN counted IS NULL OR abs(drift) < {RATE // 1000} THEN 0 WHEN drift > {MAX_GAP} THEN drift
    WHEN -drift > {MAX_GAP} THEN least(-drift, m) ELSE soft END AS amount,
  CASE WHEN counted IS NULL THEN 0 WHEN -drift > {MAX_GAP} THEN m - least(-drift, m) ELSE m END AS emitted
FROM b LEFT JOIN act USING (session_id, stream_id, seq)"""


CORRECTED = ["stream_id", "seq", "skipped", "counted", "action", "amount", "emitted"]
SQL_CORRECTED = f"SELECT {', '.join(CORRECTED)} FROM ({{}})"


def blocks_after_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as counted blocks; origin one day after the first event, so early blocks are trimmed."""
    rows = events(spark, sf_dir).withColumn("units", units_of())
    first = rows.groupBy("session_id").agg((F.min("us") + DAY).alias("t0"))
    return lookup_join(rows, first, ["session_id"], spread_by=["seq"])


@query("applied_correction", SQL_CORRECTED.format(sql_correction(f"min(us) + {DAY}")))
def applied_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.apply_corrections(blocks_after_a_day(spark, sf_dir), RATE, MAX_GAP, tb_us=TB_US).select(*CORRECTED)


@query("applied_correction_closed_loop", SQL_CORRECTED.format(sql_correction(f"min(us) + {DAY}", closed_loop=True)))
def applied_correction_closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compensated units move the clock."""
    rows = blocks_after_a_day(spark, sf_dir)
    return drift.apply_corrections(rows, RATE, MAX_GAP, tb_us=TB_US, closed_loop=True).select(*CORRECTED)


@query("uncorrected_clock", f"""WITH {sql_observations()}, t AS (SELECT min(us) + {DAY} AS t0 FROM obs),
s AS (SELECT stream_id, seq, us, us - t0 AS start, 1 + seq % 3 AS n FROM obs, t),
k AS (SELECT *, least(greatest({_sql_units('greatest(-start, 0)')}, 0), n) AS skipped FROM s)
SELECT stream_id, seq, skipped, CASE WHEN skipped < n THEN CAST(coalesce(sum(n - skipped) OVER (PARTITION BY stream_id
  ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS counted,
  CASE WHEN skipped < n THEN 'none' ELSE 'trimmed' END AS action, n - skipped AS emitted FROM k""")
def uncorrected_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections switched off."""
    rows = events(spark, sf_dir).withColumn("units", units_of())
    first = rows.groupBy("session_id").agg((F.min("us") + DAY).alias("t0"))
    rows = lookup_join(rows, first, ["session_id"], spread_by=["seq"])
    out = drift.apply_corrections(rows, RATE, MAX_GAP, tb_us=TB_US, enabled=False)
    return out.select("stream_id", "seq", "skipped", "counted", "action", "emitted")


@query("gap_segments", f"""WITH {sql_observations()},
g AS (SELECT *, coalesce(abs(us - (lag(us) OVER w + {HOUR // 2})) > {HOUR}, FALSE) AS discontinuity FROM obs
  WINDOW w AS (PARTITION BY stream_id ORDER BY us, seq)),
s AS (SELECT *, CAST(sum(discontinuity::BIGINT) OVER (PARTITION BY stream_id ORDER BY us, seq) AS BIGINT) AS segment FROM g)
SELECT stream_id, segment, count(*) AS rows, min(us) AS from_us, max(us) AS to_us FROM s GROUP BY 1, 2""")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drift.segment_by_gap(events(spark, sf_dir), F.lit(HOUR // 2), HOUR)
    return cut.groupBy("stream_id", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("us").alias("from_us"), F.max("us").alias("to_us")
    )


@query("fill_blocks", f"""WITH {sql_observations()},
g AS (SELECT *, (us - lag(us) OVER (PARTITION BY stream_id ORDER BY us, seq)) // 1000000 - 3600 AS missing FROM obs),
b AS (SELECT stream_id, seq, missing, unnest(range((missing - 1) // 1024 + 1)) AS block FROM g WHERE missing > 0)
SELECT stream_id, seq, block, least(1024, missing - block * 1024) AS units FROM b""")
def fill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero blocks for what is missing beyond an hour, at one unit per second."""
    cut = drift.segment_by_gap(events(spark, sf_dir), F.lit(HOUR), 0)
    gaps = cut.withColumn("missing", F.expr("(us - expected_us + 3600000000) div 1000000 - 3600"))
    return blocks.fill_blocks(gaps, "missing").select("stream_id", "seq", "block", "units")


def block_ends(samples: str = "samples") -> list:
    return [
        F.size(samples).cast("bigint").alias("samples_left"),
        F.get(samples, F.lit(0)).cast("double").alias("first_sample"),
        F.get(samples, F.size(samples) - 1).cast("double").alias("last_sample"),
    ]


@query("leading_trim", """WITH c AS (SELECT label, vec_id, embedding, vec_id * 1000 AS us FROM embeddings),
o AS (SELECT label, min(us) + 40500 AS t0 FROM c GROUP BY label),
s AS (SELECT *, greatest((t0 - us) * 32000 // 1000000, 0) AS skipped FROM c JOIN o USING (label)),
k AS (SELECT *, embedding[skipped * 2 + 1:] AS left_over FROM s WHERE skipped < 32)
SELECT label, vec_id, skipped, len(left_over) AS samples_left, left_over[1]::DOUBLE AS first_sample,
  left_over[len(left_over)]::DOUBLE AS last_sample FROM k""")
def leading_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 frames per chunk of a millisecond; the origin lies in the middle of a chunk."""
    chunks = vector_chunks(spark, sf_dir)
    first = chunks.groupBy("session_id", "stream_id").agg((F.min("us") + 40_500).alias("t0"))
    rows = lookup_join(chunks, first, ["session_id", "stream_id"], spread_by=["seq"])
    kept = blocks.leading_trim(rows, 32_000)
    return kept.select(F.col("stream_id").cast("int").alias("label"), F.col("seq").alias("vec_id"), "skipped", *block_ends())


@query("head_drop", """WITH d AS (SELECT label, vec_id, embedding, least(vec_id % 40, 32) AS dropped FROM embeddings),
k AS (SELECT *, embedding[dropped * 2 + 1:] AS left_over FROM d)
SELECT label, vec_id, dropped, len(left_over) AS samples_left, left_over[1]::DOUBLE AS first_sample,
  left_over[len(left_over)]::DOUBLE AS last_sample FROM k""")
def head_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = vector_chunks(spark, sf_dir).withColumn("excess", F.col("seq") % 40)
    cut = blocks.head_drop(chunks, "excess")
    return cut.select(F.col("stream_id").cast("int").alias("label"), F.col("seq").alias("vec_id"), "dropped", *block_ends())


@query("reblock", """WITH c AS (SELECT label, vec_id, embedding[(vec_id % 7) * 2 + 1:] AS e FROM embeddings),
f AS (SELECT label, vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS v FROM c),
n AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS pos FROM f)
SELECT label, pos // 96 AS block, (pos // 96) * 48 AS pts, count(*) // 2 AS frames, count(*) < 96 AS is_partial,
  count(*) AS samples_left, arg_min(v, pos)::DOUBLE AS first_sample, arg_max(v, pos)::DOUBLE AS last_sample
FROM n GROUP BY 1, 2""")
def reblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 26 to 32 frames to blocks of 48 frames."""
    chunks = vector_chunks(spark, sf_dir).withColumn("excess", F.col("seq") % 7)
    out = blocks.reblock(blocks.head_drop(chunks, "excess"), 48)
    label = F.col("stream_id").cast("int").alias("label")
    return out.select(label, "block", "pts", "frames", "is_partial", *block_ends())


@query("deinterleave", """WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)
SELECT vec_id, i % 2 AS channel, count(*) AS samples_left, arg_min(v, i)::DOUBLE AS first_sample,
  arg_max(v, i)::DOUBLE AS last_sample FROM f GROUP BY 1, 2""")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = F.posexplode(blocks.deinterleave(F.col("samples"), 2)).alias("channel", "plane")
    rows = vector_chunks(spark, sf_dir).select(F.col("seq").alias("vec_id"), planes)
    return rows.select("vec_id", F.col("channel").cast("bigint").alias("channel"), *block_ends("plane"))
