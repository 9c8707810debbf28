"""Sources, scalars, formatting, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.functions import lookups, scalars
from streamgrid.operators import rules, written
from streamgrid.operators.merge import warn_once as first_warnings
from streamgrid.plans.inputs import (
    FINE,
    HOUR,
    events,
    sql_div_round,
    sql_fill,
    sql_observations,
    table,
    units_of,
)
from streamgrid.plans.registry import query
from streamgrid.plans.regularise import regularise
from streamgrid.sources import sinks
from streamgrid.sources.observations import backdate as backdated
from streamgrid.sources.observations import choose_event_time, malformed_reason, micros, split_malformed
from streamgrid.sources.observations import time_spine as spine

SQL_HEADER = "CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) END"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    header = F.when(F.col("seq") % 7 == 0, 0).when(F.col("seq") % 11 == 0, None).otherwise(F.col("us"))
    return choose_event_time(rows.withColumn("header_us", header), "header_us", "arrival_us", out="event_us")


@query("observation_scan", f"""WITH {sql_observations()}
SELECT session_id, stream_id, seq, us, arrival_us, value FROM obs
WHERE us >= epoch_us(TIMESTAMP '2024-01-15 00:00:00')""")
def observation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is on the raw column, so it reaches the Parquet reader."""
    rows = events(spark, sf_dir, where=F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return rows.select("session_id", "stream_id", "seq", "us", "arrival_us", "value")


@query("event_time_choice", f"""WITH h AS (SELECT *, {SQL_HEADER} AS header FROM events), {sql_observations()}
SELECT stream_id, seq, CASE WHEN coalesce(header > 0, FALSE) THEN header ELSE arrival_us END AS event_us,
  NOT coalesce(header > 0, FALSE) AS used_fallback FROM obs JOIN h ON h.event_id = obs.seq""")
def event_time_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("stream_id", "seq", "event_us", "used_fallback")


@query("warn_once", f"""WITH h AS (SELECT *, {SQL_HEADER} AS header FROM events)
SELECT 'all' AS session_id, event_type AS stream_id, 'missing_header' AS kind, min(epoch_us(ts)) AS us,
  arg_min(event_id, (epoch_us(ts), event_id)) AS seq, count(*) AS occurrences
FROM h WHERE NOT coalesce(header > 0, FALSE) GROUP BY event_type""")
def warn_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fallback of every stream is the one to report."""
    fallbacks = _headers(spark, sf_dir).filter("used_fallback").withColumn("kind", F.lit("missing_header"))
    return first_warnings(fallbacks)


@query("backdate", f"""WITH {sql_observations()}
SELECT stream_id, seq, arrival_us - (seq % 50) * 1000 - (1 + seq % 3) * 1000000 // 48000 AS start_us FROM obs""")
def backdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("latency_us", (F.col("seq") % 50) * 1000).withColumn("units", units_of())
    return backdated(rows, "arrival_us", "latency_us", "units", 48_000, out="start_us").select(
        "stream_id", "seq", "start_us"
    )


@query("malformed_split", """WITH r AS (SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS owner,
    CASE WHEN event_id % 10 = 0 THEN 0 ELSE length(props) END AS size, 8 + event_id % 3 AS announced FROM events)
SELECT CASE WHEN owner IS NULL THEN 'null_owner' WHEN size = 0 THEN 'empty' WHEN size < announced THEN 'short'
    WHEN size % 2 <> 0 THEN 'incomplete' ELSE 'good' END AS reason, count(*) AS rows
FROM r GROUP BY 1""")
def malformed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows keep their first reason; good and rejected rows add up."""
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("owner"),
        F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.length("props")).alias("size"),
        (F.lit(8) + F.col("event_id") % 3).alias("announced"),
    )
    reason = malformed_reason(F.col("size"), F.col("announced"), F.lit(2), required=("owner",))
    good, rejected = split_malformed(rows, reason)
    both = rejected.select("reason").unionByName(good.select(F.lit("good").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("document_size_audit", """SELECT lang, CASE WHEN length(text) IS NULL OR length(text) = 0 THEN 'empty'
    WHEN length(text) < n_chars THEN 'short' ELSE 'good' END AS reason, count(*) AS rows
FROM documents GROUP BY 1, 2""")
def document_size_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads shorter than announced, over the whole texts."""
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("size"), "n_chars")
    tagged = rows.withColumn("reason", F.coalesce(malformed_reason(F.col("size"), F.col("n_chars")), F.lit("good")))
    return tagged.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query("time_spine", f"""WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
s AS (SELECT k, lo + k * {HOUR} AS us FROM b, unnest(range((hi - lo) // {HOUR} + 1)) AS t(k)),
c AS (SELECT (epoch_us(ts) - lo) // {HOUR} AS k, count(*) AS rows, max(value) AS peak FROM events, b GROUP BY 1)
SELECT s.k, s.us, coalesce(rows, 0) AS rows, peak FROM s LEFT JOIN c USING (k)""")
def time_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per spine period, empty periods included."""
    rows = events(spark, sf_dir)
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    counts = rows.groupBy(scalars.floor_div(F.col("us") - low, HOUR).alias("k")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("value").alias("peak")
    )
    joined = spine(spark, low, high, HOUR).join(counts, "k", "left")
    return joined.select("k", "us", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), "peak")


@query("time_arithmetic", f"""WITH m AS (SELECT event_id, epoch_us(ts) AS us, CAST(event_id * 977 - 3000000 AS BIGINT) AS n,
    1000 + event_id % 17 AS d FROM events)
SELECT event_id, {sql_div_round('n', 'd')} AS rounded,
  CAST(floor(n / d) AS BIGINT) AS floored, CAST(ceil(n / d) AS BIGINT) AS ceiled,
  {sql_div_round('n * 3', 2)} AS rescaled,
  greatest(0, n) // 1000 AS latency_us, 1704067200000000 + n * 1000 + 500 AS deadline,
  n / 48000 AS seconds, greatest(n, 0) AS saturated FROM m""")
def time_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("event_id") * 977 - 3_000_000, F.lit(1000) + F.col("event_id") % 17
    return table(spark, sf_dir, "events").select(
        "event_id",
        scalars.div_round(n, d).alias("rounded"),
        scalars.floor_div(n, d).alias("floored"),
        scalars.ceil_div(n, d).alias("ceiled"),
        scalars.rescale_ts(n, 3, 1000, 2, 1000).alias("rescaled"),
        scalars.clamped_latency_us(n, F.lit(0)).alias("latency_us"),
        scalars.deadline_of(n, F.lit(1_704_067_200_000_000), 1000, 500).alias("deadline"),
        scalars.ticks_to_seconds(n, 1, 48_000).alias("seconds"),
        scalars.saturate_non_negative(n).alias("saturated"),
    )


@query("report_format", """WITH u AS (SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 AS secs,
    CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY user_id)
SELECT user_id, printf('%d:%02d:%02d', secs // 3600, (secs // 60) % 60, secs % 60) AS duration,
  CASE WHEN bytes < 1024 THEN printf('%d o', bytes) WHEN bytes < 1048576 THEN printf('%.1f Kio', bytes / 1024.0)
    WHEN bytes < 1073741824 THEN printf('%.1f Mio', bytes / 1048576.0)
    ELSE printf('%.1f Gio', bytes / 1073741824.0) END AS size,
  CASE WHEN bytes * 8 >= 1000000 THEN printf('%.1f Mb/s', bytes * 8 / 1e6)
    WHEN bytes * 8 >= 1000 THEN printf('%.0f kb/s', bytes * 8 / 1e3)
    ELSE printf('%d b/s', bytes * 8) END AS bitrate FROM u""")
def report_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        scalars.int_div(F.max(micros("ts")) - F.min(micros("ts")), 1_000_000).alias("secs"),
        F.sum("event_id").alias("bytes"),
    )
    return rows.select(
        "user_id",
        scalars.format_duration("secs").alias("duration"),
        scalars.format_bytes("bytes").alias("size"),
        scalars.format_bitrate(F.col("bytes") * 8).alias("bitrate"),
    )


@query("unit_conversions", """SELECT event_id AS seq, (event_id * 7919) / 1e6 AS seconds, (event_id * 7919) / 1e3 AS ms,
  (event_id * 8.0::DOUBLE) / (1 + event_id % 3) AS bits_per_sec,
  (event_id * 977 * 90000 + 500 * (1 + event_id % 3)) // (1000 * (1 + event_id % 3)) AS ticks FROM events""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time bases of the rescaled ticks are columns."""
    rows = table(spark, sf_dir, "events").select("event_id")
    wide, parts = F.col("event_id") * 7919, F.lit(1) + F.col("event_id") % 3
    return rows.select(
        F.col("event_id").alias("seq"),
        scalars.us_to_seconds(wide).alias("seconds"),
        scalars.us_to_ms(wide).alias("ms"),
        scalars.bytes_to_bits_per_sec("event_id", parts).alias("bits_per_sec"),
        scalars.rescale_ts(F.col("event_id") * 977, F.lit(1), 1000 * parts, F.lit(1), F.lit(90000)).alias("ticks"),
    )


@query("extension_align", """WITH p AS (SELECT page_id,
    url || CASE page_id % 4 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' WHEN 2 THEN '' ELSE '/.hidden' END AS path FROM pages),
n AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
e AS (SELECT *, CASE WHEN instr(name[2:], '.') > 0 THEN regexp_extract(name, '([^.]*)$', 1) END AS ext FROM n)
SELECT page_id, CASE WHEN lower(ext) = 'mkv' THEN path WHEN ext IS NULL THEN path || '.mkv'
  ELSE path[:length(path) - length(ext) - 1] || '.mkv' END AS path FROM e""")
def extension_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = (
        F.when(F.col("page_id") % 4 == 0, ".MKV").when(F.col("page_id") % 4 == 1, ".mp4")
        .when(F.col("page_id") % 4 == 2, "").otherwise("/.hidden")
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", suffix).alias("path"))
    return pages.select("page_id", scalars.align_extension("path", "mkv").alias("path"))


@query("segments", f"""WITH {sql_fill(FINE, 2)}
SELECT stream_id, CAST(floor(slot / 144.0) AS BIGINT) AS segment, count(*) AS rows, min(slot) AS first_slot
FROM filled GROUP BY 1, 2""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one day of ten-minute slots (2 s at 72 slots per second in the gop formula)."""
    gop = max(1, round(2.0 * 72))
    filled = sinks.with_segment(regularise(events(spark, sf_dir), FINE, max_fill=2), gop)
    return filled.groupBy("stream_id", "segment").agg(F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first_slot"))


@query("write_readback", f"""WITH {sql_observations()}
SELECT session_id, stream_id, count(*) AS rows, min(us) AS min_us, max(us) AS max_us, count(*) AS rows_read,
  min(us) AS min_us_read, max(us) AS max_us_read, TRUE AS ok FROM obs GROUP BY ALL""")
def write_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write in merge order, one folder per week, then re-read and compare."""
    rows = events(spark, sf_dir)
    path = sinks.scratch_path(spark, "merged")
    sinks.write_merged(sinks.with_segment(rows, 7 * 24 * HOUR, slot="us"), path, partition_by=["segment"])
    return sinks.verify_written(spark, path, rows)


@query("written_order", f"""WITH {sql_observations()}
SELECT us // {7 * 24 * HOUR} AS segment, count(*) AS rows, min(us) AS low, max(us) AS high, CAST(0 AS BIGINT) AS backward,
  CAST(0 AS BIGINT) AS stepped, TRUE AS in_order FROM obs GROUP BY 1""")
def written_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write in merge order, one folder per week, and audit the files."""
    path = sinks.scratch_path(spark, "merged")
    sinks.write_merged(sinks.with_segment(events(spark, sf_dir), 7 * 24 * HOUR, slot="us"), path, partition_by=["segment"])
    segment = F.regexp_extract("folder", "segment=(-?[0-9]+)$", 1).cast("bigint").alias("segment")
    return written.written_order(spark, path).select(segment, "rows", "low", "high", "backward", "stepped", "in_order")


@query("suffix_class", """SELECT s_suppkey, CASE WHEN name IN ('libx264', 'libx265', 'libsvtav1') THEN 'software'
    WHEN name LIKE '%\\_vaapi' ESCAPE '\\' OR name LIKE '%\\_qsv' ESCAPE '\\' THEN 'hw_frames'
    WHEN name LIKE '%\\_nvenc' ESCAPE '\\' OR name LIKE '%\\_amf' ESCAPE '\\' OR name LIKE '%\\_mf' ESCAPE '\\'
      THEN 'hw_direct' ELSE 'software' END AS class
FROM (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'h264_vaapi' WHEN 1 THEN 'vp9_qsv' WHEN 2 THEN 'h264_mf'
    WHEN 3 THEN 'libx264' WHEN 4 THEN 'av1_nvenc' WHEN 5 THEN lower(s_name) ELSE s_name || '_amf' END AS name FROM supplier)""")
def suffix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey") % 7
    name = (
        F.when(key == 0, "h264_vaapi").when(key == 1, "vp9_qsv").when(key == 2, "h264_mf").when(key == 3, "libx264")
        .when(key == 4, "av1_nvenc").when(key == 5, F.lower("s_name")).otherwise(F.concat("s_name", F.lit("_amf")))
    )
    named = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return lookups.classify_by_suffix(named, "name").select("s_suppkey", "class")


SQL_CODE = "CASE c_custkey % 6 WHEN 0 THEN 32902 WHEN 1 THEN 4098 WHEN 2 THEN 4130 WHEN 3 THEN 4318 ELSE c_custkey END"


@query("code_labels", f"""SELECT vendor, count(*) AS rows FROM (SELECT CASE {SQL_CODE} WHEN 32902 THEN 'intel'
  WHEN 4098 THEN 'amd' WHEN 4130 THEN 'amd' WHEN 4318 THEN 'nvidia' ELSE 'other' END AS vendor FROM customer) GROUP BY 1""")
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "customer").select(F.expr(SQL_CODE).alias("code"))
    return lookups.code_label(codes, "code").groupBy("vendor").agg(F.count(F.lit(1)).alias("rows"))


@query("raw_volume", """SELECT format, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) * 60.0 / 1048576, 3) AS mib_per_sec
FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'nv12' WHEN 1 THEN 'bgrx' ELSE 'rgba' END AS format,
  CASE p_partkey % 3 WHEN 0 THEN p_size * 64 * (p_size * 30) * 3 // 2 ELSE p_size * 64 * 4 * (p_size * 30) END AS bytes
  FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)) GROUP BY format""")
def raw_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 3
    size = F.col("p_size").cast("bigint")
    rows = table(spark, sf_dir, "part").select(
        F.when(key == 0, "nv12").when(key == 1, "bgrx").otherwise("rgba").alias("format"),
        (size * 64 * F.when(key == 0, 1).otherwise(4)).alias("stride"),
        (size * 30).alias("height"),
    )
    rows = rows.withColumn("bytes", scalars.raw_volume("stride", "height", "format"))
    return rows.groupBy("format").agg(
        F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") * 60.0 / 1048576, 3).alias("mib_per_sec")
    )


@query("unknown_keys", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id % 5 ELSE 'extra' END AS key
FROM events WHERE event_id % 3 <> 1""")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose properties carry keys that are not known."""
    key = F.col("event_id") % 3
    other = F.concat(F.lit('{"x'), F.col("event_id") % 5, F.lit('": 1, "k"'))
    props = (
        F.when(key == 0, F.regexp_replace("props", F.lit('\\{"k"'), other))
        .when(key == 2, F.regexp_replace("props", F.lit("\\}"), F.lit(', "extra": 2}')))
        .otherwise(F.col("props"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", props.alias("props"))
    return rules.unknown_keys(rows, "props", ["k"]).select("event_id", F.explode("unknown_keys").alias("key"))


@query("alias_normalise", """SELECT codec, quality, count(*) AS rows FROM (SELECT
    CASE p_partkey % 5 WHEN 0 THEN 'hevc' WHEN 1 THEN 'hevc' WHEN 2 THEN 'hevc' WHEN 3 THEN 'h264' ELSE 'av1' END AS codec,
    CASE p_size % 3 WHEN 0 THEN 'very_high' WHEN 1 THEN 'very_high' ELSE 'low' END AS quality FROM part) GROUP BY 1, 2""")
def alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey") % 5, F.col("p_size") % 3
    codec = F.when(key == 0, "H265").when(key == 1, "h.265").when(key == 2, "HEVC").when(key == 3, "H264").otherwise("av1")
    quality = F.when(size == 0, "VeryHigh").when(size == 1, "very_high").otherwise("LOW")
    rows = table(spark, sf_dir, "part").select(codec.alias("raw_codec"), quality.alias("raw_quality"))
    rows = lookups.normalise_alias(rows, "raw_codec", lookups.CODEC_ALIASES, "codec")
    rows = lookups.normalise_alias(rows, "raw_quality", lookups.QUALITY_ALIASES, "quality")
    return rows.groupBy("codec", "quality").agg(F.count(F.lit(1)).alias("rows"))
