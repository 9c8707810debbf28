"""Streams over several files give what the batch operators give."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.operators import blocks, drift, grid
from streamgrid.operators.origin import attach_origin, common_origin, trim_pre_origin
from streamgrid.schema import OBSERVATIONS
from streamgrid.streaming import operators, processors, replay, sinks, windows

P = 1_000_000
LOOKAHEAD = 2_000_000


@pytest.fixture
def feed(spark, observe, tmp_path):
    """(batch frame, stream frame) of the same rows, delivered in arrival order in several micro-batches."""

    def make(data, files=4):
        ordered = sorted(data, key=lambda r: (r[4] if len(r) > 4 else r[2], r[1]))
        folder = tmp_path / "in"
        step = -(-len(ordered) // files)
        for i in range(0, len(ordered), step):
            part = observe(ordered[i : i + step]).select(*OBSERVATIONS.fieldNames())
            part.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return observe(data).drop("t0"), stream

    return make


def _walk(seed, n=120, delay=0):
    rng = random.Random(seed)
    us, data = 0, []
    for i in range(n):
        us += rng.choice([200_000, 900_000, 1_100_000, 3_400_000, 9_000_000])
        data.append((rng.choice("ab"), i, us, i, us + rng.randrange(0, delay + 1)))
    return data


def test_grid_is_a_prefix_of_the_batch_grid(spark, feed):
    batch, stream = feed(_walk(1, delay=4_000_000))
    late = grid.reslot_late(
        grid.assign_slots(batch.withColumn("t0", F.lit(0).cast("bigint")), P), P, LOOKAHEAD
    )
    whole = grid.fill_gaps(grid.coalesce_slots(late, by_arrival=True), max_fill=3)
    slots = operators.stream_slots(stream, P, 0, LOOKAHEAD)
    got = sinks.drain(spark, operators.stream_fill(slots, 3), "grid")
    columns = ["stream_id", "slot", "slot_to", "status", "us", "value", "superseded", "late", "lost"]
    streamed, expected = rows(got, *columns), set(rows(whole, *columns))
    assert set(streamed) <= expected
    # Only what the watermark has not passed is missing.
    top = whole.agg(F.max("slot")).first()[0] - (LOOKAHEAD + P) // P
    assert {r for r in expected if r[2] < top and r[3] == "fresh"} <= set(streamed)
    assert sum(r[7] for r in streamed) > 0 and len(streamed) == len(set(streamed))


def test_clock_equals_the_batch_correction(spark, feed):
    data = [(s, i, us, 5 + i % 40) for s, i, us, *_ in _walk(2)]
    batch, stream = feed(data)
    units = F.col("value").cast("bigint")
    want = drift.apply_corrections(batch.withColumn("t0", F.lit(5_000_000).cast("bigint")).withColumn("units", units), 10, 40)
    got = sinks.drain(spark, operators.stream_clock(stream.withColumn("units", units), 10, 40, 5_000_000), "clock")
    live = want.filter("action <> 'trimmed'")
    assert rows(got, "stream_id", "seq", "expected", "counted", "drift") == rows(
        live, "stream_id", "seq", "expected", "counted", "drift"
    )


def test_strict_thinning_across_batches(spark, feed):
    data = [(s, i, us - (i % 7) * 2_000_000, i, us) for i, (s, _, us, *_) in enumerate(_walk(3))]
    batch, stream = feed(data)
    want = grid.monotonic_thin(batch.withColumn("t0", F.lit(0).cast("bigint")))
    got = sinks.drain(spark, operators.stream_thin(stream), "thin")
    assert rows(got, "stream_id", "seq") == rows(want, "stream_id", "seq")


def test_barrier_resolves_completely_by_timeout_and_after_withdrawal(spark, observe, tmp_path):
    second = 1_000_000
    batches = [
        [("full", "a", 1 * second), ("short", "a", 1 * second), ("left", "a", 2 * second)],
        [("full", "b", 3 * second), ("short", "a", 4 * second), ("left", "b", None)],
        [("full", "b", 30 * second), ("short", "b", 60 * second), ("other", "a", 90 * second)],
    ]
    for part in batches:
        df = spark.createDataFrame(part, "session_id string, stream_id string, us bigint")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("session_id string, stream_id string, us bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    got = sinks.drain(spark, operators.start_barrier(stream, 2, 10 * second), "barrier")
    assert rows(got, "session_id", "t0", "streams", "timed_out") == [
        ("full", 3 * second, 2, False),
        ("left", 2 * second, 1, False),
        ("short", 1 * second, 1, True),
    ]


def test_late_rows_of_plain_windows_are_counted_not_hidden(spark, feed):
    data = [("a", i, i * P, i, i * P) for i in range(40)] + [("a", 99, 0, 0, 100 * P)]
    _, stream = feed(data)
    counted = windows.tick_counters(windows.with_lookahead(stream, "2 seconds"), "5 seconds", {"n": F.lit(1)})
    path = sinks.scratch_path(spark, "late")
    query = sinks.write_available(counted, path + "/data", path + "/checkpoint")
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert dropped == 1
    assert spark.read.parquet(path + "/data").agg(F.sum("n")).first()[0] <= 40


def test_restart_continues_from_the_checkpoint(spark, feed):
    _, stream = feed(_walk(4))
    path = sinks.scratch_path(spark, "restart")
    for _ in range(2):
        sinks.write_available(stream.select("session_id", "seq"), path + "/data", path + "/checkpoint", ["session_id"])
    assert spark.read.parquet(path + "/data").count() == 120


def test_status_table_and_listener(spark, feed):
    _, stream = feed(_walk(5))
    listener = sinks.RateListener()
    spark.streams.addListener(listener)
    path = sinks.scratch_path(spark, "status")
    try:
        sinks.write_status(stream, path + "/data", path + "/checkpoint", ["stream_id"])
    finally:
        spark.streams.removeListener(listener)
    status = spark.read.parquet(path + "/data")
    assert status.agg(F.sum("rows")).first()[0] == 120
    assert status.select("batch").distinct().count() == 4
    sinks.status_writer(path + "/data", ["stream_id"])(status.filter("batch = 0").withColumn("us", F.col("from_us")), 0)
    assert all(r["rows"] >= 0 for r in listener.reports)


SECOND = 1_000_000


def _sessions(seed, n=400):
    """Four sessions of up to three streams; streams start late, and one session lacks a stream."""
    rng, us, data = random.Random(seed), 0, []
    starts = {(s, t): rng.randrange(0, 40) * SECOND for s in "pqrs" for t in "abc"}
    del starts["s", "c"]
    for i in range(n):
        us += rng.choice([100_000, 300_000, 700_000, 2_600_000])
        open_ = [k for k, start in starts.items() if us >= start]
        if open_:
            data.append((*rng.choice(open_), i, us, float(i % 50)))
    return data


SESSION_ROWS = "session_id string, stream_id string, seq bigint, us bigint, value double"


@pytest.fixture
def session_feed(spark, tmp_path):
    """(batch frame, stream frame, replay) of session rows in time order, with an end mark."""

    def make(data, end_after=500 * SECOND):
        df = spark.createDataFrame(data, SESSION_ROWS)
        written = replay.write_replay(df, F.col("us"), {"us": F.col("_last") + end_after}, parts=5)
        stream = (
            spark.readStream.schema(df.schema).option("maxFilesPerTrigger", written.files_per_trigger).parquet(written.path)
        )
        return df, stream, written

    return make


def _finished(df, spark, name):
    """What a stream wrote, and the state rows of its last micro-batch."""
    path = sinks.scratch_path(spark, name)
    query = sinks.write_available(df, path + "/data", path + "/checkpoint")
    assert len(query.recentProgress) >= 5
    state = sum(s.numRowsTotal for s in query.recentProgress[-1].stateOperators)
    return spark.read.schema(df.schema).parquet(path + "/data"), state


@pytest.mark.parametrize("timeout", [15 * SECOND, 100 * SECOND])
def test_rows_wait_for_the_origin_of_their_session(spark, session_feed, timeout):
    batch, stream, _ = session_feed(_sessions(7))
    released = operators.release_at_origin(stream, 3, timeout, idle_us=200 * SECOND, salts=3)
    got, state = _finished(released, spark, "released")
    want = attach_origin(batch, common_origin(batch, timeout_us=timeout))
    assert rows(got, *SESSION_ROWS.replace(",", "").split()[::2], "t0") == rows(want, *SESSION_ROWS.replace(",", "").split()[::2], "t0")
    assert state == 0


@pytest.mark.parametrize("max_fill", [None, 2])
def test_live_grid_equals_the_batch_grid(spark, session_feed, max_fill):
    batch, stream, _ = session_feed(_sessions(8))
    released = operators.release_at_origin(stream, 3, 15 * SECOND, idle_us=200 * SECOND)
    got, state = _finished(operators.stream_grid(released, P, max_fill, 15 * SECOND, 200 * SECOND), spark, "live")
    kept = trim_pre_origin(attach_origin(batch, common_origin(batch, timeout_us=15 * SECOND)))
    want = grid.fill_gaps(grid.coalesce_slots(grid.assign_slots(kept, P)), max_fill)
    columns = ["session_id", "stream_id", "slot", "slot_to", "status", "us", "seq", "value", "superseded", "lost"]
    assert rows(got, *columns) == rows(want, *columns)
    assert state == 0


@pytest.mark.parametrize("closed_loop", [False, True])
def test_live_correction_equals_the_batch_correction(spark, session_feed, closed_loop):
    batch, stream, _ = session_feed(_sessions(9))
    units = (F.col("value") % 13).cast("bigint")
    released = operators.release_at_origin(stream.withColumn("units", units), 3, 15 * SECOND, idle_us=200 * SECOND)
    got, state = _finished(
        operators.stream_correction(released, 10, 40, closed_loop=closed_loop, idle_us=200 * SECOND), spark, "corrected"
    )
    blocks = attach_origin(batch, common_origin(batch, timeout_us=15 * SECOND)).withColumn("units", units)
    want = drift.apply_corrections(blocks, 10, 40, closed_loop=closed_loop)
    columns = ["session_id", "stream_id", "seq", "skipped", "counted", "action", "amount", "emitted"]
    assert rows(got, *columns) == rows(want, *columns)
    assert len({r[5] for r in rows(got, *columns)}) >= 3
    assert state == 0


def test_thinning_and_barrier_end_with_their_streams(spark, session_feed):
    data = [(s, t, i, us, v) for s, t, i, us, v in _sessions(10)]
    _, stream, _ = session_feed([*data, ("p", "a", 9999, None, 0.0)])
    timed = stream.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "0 seconds")
    thin = operators.stream_thin(timed.withColumn("arrival_us", F.col("us")), idle_us=200 * SECOND)
    got, state = _finished(thin.filter("session_id IS NOT NULL"), spark, "thin-end")
    # The end mark itself is a stream without keys; its state is all that is left.
    assert got.filter("seq = 9999").count() == 0 and state <= 2
    barrier = operators.start_barrier(stream, 3, 15 * SECOND, idle_us=200 * SECOND)
    got, state = _finished(barrier, spark, "barrier-end")
    assert got.count() == 4 and state == 0


def test_replay_orders_any_spread_of_times(spark):
    rng = random.Random(3)
    times = [0] * 300 + [rng.randrange(100) for _ in range(100)] + [10**12 + i for i in range(200)] + [None] * 7
    rng.shuffle(times)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id bigint, us bigint").repartition(3)
    written = replay.write_replay(df, F.col("us"), {"us": F.col("_last") + 5}, parts=4)
    seen = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(written.path)
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: seen.append([r["us"] for r in batch.collect()]))
        .option("checkpointLocation", sinks.scratch_path(spark, "seen")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(t for part in seen for t in part) == sorted([t for t in times if t is not None] + [10**12 + 204])
    filled = [part for part in seen if part]
    assert all(max(a) <= min(b) for a, b in zip(filled, filled[1:], strict=False))
    assert filled[-1] == [10**12 + 204] and max(map(len, filled)) < 300
    schema = "id bigint, us bigint"
    assert replay.untimed_rows(spark, written, schema).count() == 7
    empty = replay.write_replay(df.limit(0), F.col("us"), {"us": F.col("_last") + 5})
    assert spark.read.schema(df.schema).parquet(empty.path).count() == 0
    assert replay.untimed_rows(spark, empty, schema).count() == 0


def _parts(spark, folder, parts, schema):
    """A stream of one file per part, in this order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_merge_waits_for_slow_streams_and_ends_with_them(spark, tmp_path):
    rng, parts, sent = random.Random(4), [[] for _ in range(6)], []
    for session in ("x", "y"):
        for index in range(3):
            dts = sorted(rng.randrange(30) for _ in range(20))
            packets = [(session, index, i, t + rng.randrange(3), t, "data") for i, t in enumerate(dts)]
            sent += packets
            packets.append((session, index, None, None, None, "eof"))
            cuts = sorted(rng.randrange(21) for _ in range(4)) + [21]
            for i, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
                parts[min(i + index, 5)] += packets[a:b]
    schema = "session_id string, stream_index int, seq bigint, pts bigint, dts bigint, kind string"
    merged = operators.stream_merge(_parts(spark, tmp_path / "in", parts, schema), 3)
    got, state = _finished(merged, spark, "merge")
    want = []
    for session in ("x", "y"):
        ordered = sorted((p for p in sent if p[0] == session), key=lambda p: (p[4], p[1], p[2]))
        want += [(session, "data", p[1], p[2], p[3], p[4], i + 1) for i, p in enumerate(ordered)]
        want.append((session, "complete", None, None, None, None, len(ordered)))
    assert rows(got, *got.columns) == sorted(want, key=repr)
    assert state == 0


def test_live_blocks_equal_the_batch_blocks(spark, tmp_path):
    rng, parts, us = random.Random(6), [], 0
    for _ in range(5):
        part = []
        for _ in range(12):
            us += 10
            part.append(("s", rng.choice("ab"), us, us, 2, [float(us + i) for i in range(2 * rng.randrange(0, 9))]))
        parts.append(part)
    schema = "session_id string, stream_id string, us bigint, seq bigint, channels int, samples array<float>"
    want = blocks.reblock(spark.createDataFrame([r for p in parts for r in p], schema), 16)
    parts.append([("s", t, us + 1, None, None, None) for t in "ab"])
    got, state = _finished(operators.stream_reblock(_parts(spark, tmp_path / "in", parts, schema), 16), spark, "blocks")
    columns = ["stream_id", "block", "pts", "channels", "frames", "is_partial", "samples"]
    assert rows(got, *columns) == rows(want, *columns)
    assert state == 0


def test_status_rows_count_missing_latencies_and_end(spark, session_feed):
    data = _sessions(12)
    _, stream, _ = session_feed(data)
    timed = windows.with_lookahead(stream.withColumn("ts", F.timestamp_micros("us")), "0 seconds")
    timed = timed.withColumn("latency", F.when(F.col("seq") % 3 != 0, F.col("seq") * 10))
    counters = {"dropped": F.col("value") > 40, "bytes": F.col("value")}
    got, state = _finished(operators.stream_dashboard(timed, 20 * SECOND, "latency", counters, 200 * SECOND), spark, "status")
    last = {r["session_id"]: r for r in got.orderBy("at_us").collect()}
    for session in "pqrs":
        mine = [r for r in data if r[0] == session]
        slow = sorted(r[2] * 10 for r in mine if r[2] % 3)
        row = last[session]
        assert (row["received"], row["dropped"]) == (len(mine), sum(r[4] > 40 for r in mine))
        assert row["bytes"] == sum(int(r[4]) for r in mine)
        assert slow[-1] * 0.98 <= row["p99_us"] <= slow[-1] * 1.001
    # The end mark is a session of its own and the last row of all.
    assert state <= 3


class _Handle:
    """One list state and the timers of a group, with the state accesses counted."""

    def __init__(self):
        self.rows, self.calls, self.timers, self.now = [], 0, [], 0
        self.getListState = lambda name, schema: self
        self.registerTimer = self.timers.append
        self.getCurrentWatermarkInMs = lambda: self.now

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []


def test_keys_of_a_bucket_share_calls_and_frames():
    handle, keys = _Handle(), [f"u{i}" for i in range(500)]
    barrier = processors.BucketProcessor(processors.Barrier(2, 10 * SECOND, idle_us=50 * SECOND), ["session_id"], ["first_us", "last_us"])
    barrier.init(handle)

    def send(stream, us, sessions):
        frame = pd.DataFrame({"session_id": sessions, "stream_id": stream, "first_us": us, "last_us": us})
        return [f for f in barrier.handleInputRows((0,), iter([frame]), handle)]

    assert send("a", 1 * SECOND, keys) == [] and len(handle.rows) == 500
    out = send("b", 3 * SECOND, keys[:400])
    assert [len(f) for f in out] == [400] and set(out[0]["t0"]) == {3 * SECOND}
    handle.now = 11_001
    out = [f for f in barrier.handleExpiredTimer((0,), handle, None)]
    assert [len(f) for f in out] == [100] and out[0]["timed_out"].all() and set(out[0]["t0"]) == {1 * SECOND}
    handle.now = 70_000
    assert [f for f in barrier.handleExpiredTimer((0,), handle, None)] == [] and handle.rows == []
    assert handle.calls <= 12 and len(handle.timers) <= 4
