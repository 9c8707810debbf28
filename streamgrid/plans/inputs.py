"""The test tables as observations, chunks and packets, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamgrid.schema import STREAM_KEYS
from streamgrid.sources.observations import micros, read_chunks, read_observations
from streamgrid.streaming.replay import write_replay

HOUR = 3_600_000_000
MINUTE = 60_000_000
DAY = 24 * HOUR
FINE = 10 * MINUTE

# Stand-ins for columns ``events`` lacks, written the same way in both dialects.
ARRIVAL_DELAY_US = "((event_id * 7919) % 7200) * 1000000"
UNITS = "1 + event_id % 3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_mapping(session: str) -> dict[str, Column]:
    return {
        "session_id": F.expr(session),
        "stream_id": F.col("event_type"),
        "seq": F.col("event_id"),
        "ts": F.col("ts"),
        "us": micros("ts"),
        "arrival_us": micros("ts") + F.expr(ARRIVAL_DELAY_US),
        "value": F.col("value"),
    }


def events(spark: SparkSession, sf_dir: str, where: Column | None = None, session: str = "'all'") -> DataFrame:
    """Events as observations, one stream per event type; ``session`` is an SQL expression."""
    return read_observations(spark, f"{sf_dir}/events.parquet", _event_mapping(session), where=where)


EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


END_STREAM = "end"


def events_stream(
    spark: SparkSession, sf_dir: str, session: str = "'all'", by_arrival: bool = False, end_mark: bool = False,
    end_after_us: int = 30 * DAY,
) -> DataFrame:
    """The same rows as a stream of at least four micro-batches in time (or arrival) order.

    The end mark is a row of the stream ``END_STREAM`` thirty days after the last, which closes all that is open. It
    has no user, hence no session where sessions are users.
    """
    rows = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    order = micros("ts") + F.expr(ARRIVAL_DELAY_US) if by_arrival else micros("ts")
    late = F.timestamp_micros(F.col("_last") + F.lit(end_after_us))
    end = {"event_id": F.lit(0), "ts": late.cast("timestamp_ntz"), "event_type": F.lit(END_STREAM)} if end_mark else None
    replay = write_replay(rows, order, end)
    return read_observations(
        spark, replay.path, _event_mapping(session), stream_schema=EVENTS_SCHEMA,
        files_per_trigger=replay.files_per_trigger,
    )


def _read_replay(spark: SparkSession, rows: DataFrame, order: str) -> DataFrame:
    replay = write_replay(rows, F.col(order))
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", replay.files_per_trigger)
    return reader.parquet(replay.path)


STREAM_NAMES = ("click", "error", "purchase", "signup", "view")


def packets_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as packets of five streams, each a day later than the one before, closed by end marks."""
    rows = events(spark, sf_dir, session=USER_SESSION)
    index = F.array_position(F.array(*[F.lit(n) for n in STREAM_NAMES]), F.col("stream_id")).cast("int") - 1
    packets = rows.select(
        "session_id", index.alias("stream_index"), "seq", F.col("us").alias("pts"), F.col("us").alias("dts"), F.lit("data").alias("kind")
    )
    ends = packets.groupBy("session_id", "stream_index").agg(F.max("dts").alias("dts")).withColumns(
        {"seq": F.lit(None).cast("bigint"), "pts": F.lit(None).cast("bigint"), "kind": F.lit("eof")}
    )
    late = F.col("dts") + F.col("stream_index").cast("bigint") * DAY + (F.col("kind") == "eof").cast("bigint")
    return _read_replay(spark, packets.unionByName(ends).withColumn("_at", late), "_at").drop("_at")


def chunks_stream(chunks: DataFrame) -> DataFrame:
    """Chunks as a stream in time order; a row without samples closes every stream."""
    columns = [*STREAM_KEYS, "us", "seq", "channels", "samples"]
    ends = chunks.groupBy(*STREAM_KEYS).agg((F.max("us") + 1).alias("us")).withColumns({
        "seq": F.lit(None).cast("bigint"), "channels": F.lit(None).cast("int"), "samples": F.lit(None).cast("array<float>"),
    })
    rows = chunks.select(*columns).unionByName(ends.select(*columns))
    return _read_replay(chunks.sparkSession, rows, "us")


USER_SESSION = "CAST(user_id AS STRING)"


def user_events(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    return events(spark, sf_dir, where, USER_SESSION)


def units_of(seq: str = "seq") -> Column:
    return F.lit(1) + F.col(seq) % 3


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as two-channel chunks, one stream per label, one chunk per millisecond."""
    mapping = {
        "session_id": F.lit("all"),
        "stream_id": F.col("label").cast("string"),
        "seq": F.col("vec_id"),
        "us": F.col("vec_id") * 1000,
        "channels": F.lit(2),
        "samples": F.col("embedding"),
    }
    return read_chunks(spark, f"{sf_dir}/embeddings.parquet", mapping)


def sql_div_round(n: str, d: str | int) -> str:
    return f"(CASE WHEN ({n}) >= 0 THEN (({n}) + {d} // 2) // {d} ELSE -((-({n}) + {d} // 2) // {d}) END)"


def sql_observations(session: str = "'all'") -> str:
    return f"""obs AS (
  SELECT {session} AS session_id, event_type AS stream_id, event_id AS seq, epoch_us(ts) AS us,
         epoch_us(ts) + {ARRIVAL_DELAY_US} AS arrival_us, value
  FROM events)"""


def sql_origin(session: str = "'all'", timeout: int | None = None) -> str:
    """CTEs obs, origin and kept (rows at or after the common origin t0, of the streams that start in time)."""
    in_time = "" if timeout is None else f" FILTER (f <= earliest + {timeout})"
    return f"""{sql_observations(session)},
firsts AS (SELECT session_id, stream_id, min(us) AS f, min(min(us)) OVER (PARTITION BY session_id) AS earliest
  FROM obs GROUP BY session_id, stream_id),
origin AS (SELECT session_id, max(f){in_time} AS t0, count(*) AS streams FROM firsts GROUP BY session_id),
kept AS (SELECT obs.*, t0 FROM obs JOIN origin USING (session_id) WHERE us >= t0)"""


def sql_slots(period: int, session: str = "'all'", timeout: int | None = None) -> str:
    """CTE coalesced: the last row of every slot."""
    return f"""{sql_origin(session, timeout)},
slotted AS (SELECT *, {sql_div_round('us - t0', period)} AS slot FROM kept),
coalesced AS (
  SELECT session_id, stream_id, slot, arg_max(us, (us, seq)) AS us, arg_max(seq, (us, seq)) AS seq,
         arg_max(value, (us, seq)) AS value, count(*) - 1 AS superseded
  FROM slotted GROUP BY session_id, stream_id, slot)"""


def sql_fill(period: int, max_fill: int | None = None, session: str = "'all'", timeout: int | None = None) -> str:
    """CTE filled: fresh, filled and skipped rows."""
    fits = "TRUE" if max_fill is None else f"nxt - slot - 1 <= {max_fill}"
    return f"""{sql_slots(period, session, timeout)},
runs AS (SELECT *, lead(slot) OVER (PARTITION BY session_id, stream_id ORDER BY slot) AS nxt FROM coalesced),
filled AS (
  SELECT session_id, stream_id, slot, slot AS slot_to, 'fresh' AS status, us, seq, value, superseded, 0 AS lost
  FROM runs
  UNION ALL
  SELECT session_id, stream_id, s, s, 'filled', us, seq, value, 0, 0
  FROM (SELECT *, unnest(range(slot + 1, nxt)) AS s FROM runs WHERE nxt - slot > 1 AND {fits})
  UNION ALL
  SELECT session_id, stream_id, slot + 1, nxt - 1, 'skipped', NULL, NULL, NULL, 0, nxt - slot - 1
  FROM runs WHERE nxt - slot > 1 AND NOT ({fits}))"""
