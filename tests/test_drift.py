from __future__ import annotations

import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.operators import align, drift

RATE = 48_000


def plan(spark, d, **kw):
    df = spark.range(1).select(F.lit(d).cast("bigint").alias("drift"))
    return rows(drift.plan_correction(df, RATE, drift.max_gap_units(RATE, 200), **kw), "action", "amount")[0]


@pytest.mark.parametrize(
    ("d", "expected"),
    [
        (10, ("none", 0)),
        (-10, ("none", 0)),
        (2400, ("compensate", 300)),
        (-2400, ("compensate", -300)),
        (9000, ("compensate", 480)),
        (24_000, ("insert", 24_000)),
        (-24_000, ("drop", 24_000)),
    ],
)
def test_plan(spark, d, expected):
    assert plan(spark, d) == expected


def test_correction_can_be_switched_off(spark):
    assert plan(spark, 24_000, enabled=False) == ("none", 0)


def test_drift_sign_and_media_time(observe):
    df = observe([("a", 0, 1_001_000, 0)]).withColumn("anchor_us", F.lit(1000).cast("bigint"))
    behind = drift.drift(df.withColumn("counted", F.lit(0).cast("bigint")), RATE)
    assert rows(behind, "drift", "drift_us", "media_us") == [(48_000, 1_000_000, 1000)]
    level = drift.drift(df.withColumn("counted", F.lit(48_000).cast("bigint")), RATE)
    assert rows(level, "drift", "media_us") == [(0, 1_001_000)]


def test_units_do_not_overflow(spark):
    century = 100 * 365 * 86_400 * 1_000_000
    got = spark.range(1).select(drift.units_in(F.lit(century), RATE), drift.units_in(F.lit(-century - 1), RATE)).first()
    assert tuple(got) == (century * RATE // 1_000_000, -(century * RATE // 1_000_000))


def tdiv(a, b):
    return a // b if a >= 0 else -(-a // b)


def replay(data, rate, gap, t0, closed_loop=False):
    """One stream, block by block."""
    out, counted = [], 0
    for _, seq, us, n in sorted(data, key=lambda r: (r[2], r[1])):
        skip = max(0, tdiv((t0 - us) * rate, 1_000_000)) if us < t0 else 0
        if skip >= n:
            out.append((seq, "trimmed", 0, 0, None))
            continue
        d = tdiv((us + tdiv(skip * 1_000_000, rate) - t0) * rate, 1_000_000) - counted
        before, left = counted, n - skip
        if abs(d) < max(1, rate // 1000):
            action, amount = "none", 0
        elif d > gap:
            action, amount = "insert", d
            counted += d
        elif -d > gap:
            action, amount = "drop", min(-d, left)
            left -= amount
        else:
            amount = max(-(rate // 100), min(rate // 100, tdiv(d, 8)))
            action = "compensate" if amount else "none"
            counted += amount if closed_loop else 0
        counted += left
        out.append((seq, action, amount, left, before))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("gap", [0, 40, 400])
@pytest.mark.parametrize("closed_loop", [False, True])
def test_applied_correction_matches_a_loop_also_when_split(observe, seed, gap, closed_loop):
    """Streams that run behind, ahead, and jump; cut into parts of a few blocks."""
    rng = random.Random(seed)
    rate, t0, us, data = 1000, 50_000, 0, []
    for i in range(220):
        us += rng.choice([5_000, 20_000, 20_000, 60_000, 400_000 if rng.random() < 0.1 else 10_000])
        data.append(("a", i, us, rng.choice([3, 20, 25, 90])))
    df = observe(data, t0=t0).withColumn("units", F.col("value").cast("bigint"))
    expected = replay(data, rate, gap, t0, closed_loop)
    for hot_rows in (10_000, 25):
        out = drift.apply_corrections(df, rate, gap, hot_rows=hot_rows, closed_loop=closed_loop)
        assert rows(out, "seq", "action", "amount", "emitted", "counted") == expected


@pytest.mark.parametrize("hot_rows", [10_000, 2])
def test_corrections_keep_rows_of_equal_time_and_number(observe, hot_rows):
    data = [("a", 0, 0, 10), ("a", 1, 10_000, 10), ("a", 1, 10_000, 10), ("a", 2, 20_000, 10)]
    df = observe(data).withColumn("units", F.col("value").cast("bigint"))
    out = drift.apply_corrections(df, 1000, 100, hot_rows=hot_rows)
    assert rows(out, "seq", "counted") == [(0, 0), (1, 10), (1, 20), (2, 30)]


@pytest.mark.parametrize("seed", range(30))
def test_transfer_map_matches_every_start(seed):
    rng = random.Random(seed)
    band, low = rng.choice([0, 1, 7, 60]), rng.randrange(-20, 20)
    e, expected, units = 0, [], []
    for _ in range(rng.randrange(1, 80)):
        e += rng.choice([0, 1, 5, 30, 200])
        expected.append(e)
        units.append(rng.choice([1, 1, 4, 35]))
    high = low + rng.choice([0, 1, 50, 300])
    pieces = drift._transfer(low, high, expected, units, band)
    assert [p[0] for p in pieces] == [low, *[p[1] + 1 for p in pieces[:-1]]] and pieces[-1][1] == high
    named = [dict(zip(("low", "high", "constant", "v"), p, strict=True)) for p in pieces]
    for start in range(low, high + 1):
        counted = start
        for x, m in zip(expected, units, strict=True):
            counted = drift._advance(counted, x, m, band)
        assert drift._evaluate(named, start) == counted


def _blocks(rng, count, steps, sizes):
    e, expected, units = 0, [], []
    for _ in range(count):
        e += rng.choice(steps)
        expected.append(e)
        units.append(rng.choice(sizes))
    return expected, units


@pytest.mark.parametrize("seed", range(60))
def test_eased_transfer_map_matches_every_start(seed):
    rng = random.Random(seed)
    rule = drift.Rule.of(rng.choice([900, 4000, 20_000, 48_000]), rng.choice([0, 3, 20, 60, 400, 2000]), closed_loop=True)
    expected, units = _blocks(rng, rng.randrange(1, 60), [0, 1, 5, 30, 200, 5, 6, 7], [1, 4, 35, 6])
    low = rng.randrange(-20, 20)
    high = low + rng.choice([0, 1, 50, 300, 900])
    pieces = drift._transfer_pieces(low, high, expected, units, rule)
    assert [p[0] for p in pieces] == [low, *[p[1] + 1 for p in pieces[:-1]]] and pieces[-1][1] == high
    named = [{"low": a, "high": b, "steps": [dict(zip(("kind", "a", "m"), s, strict=True)) for s in o]} for a, b, o in pieces]
    for start in range(low, high + 1):
        assert drift._follow(named, start) == rule.advance_all(start, expected, units)


@pytest.mark.parametrize("closed_loop", [False, True])
def test_transfer_over_a_wide_band_holds_few_pieces(closed_loop):
    rng, gap = random.Random(7), 400_000_000
    rule = drift.Rule.of(48_000 * 20_000, gap, closed_loop)
    expected, units = _blocks(rng, 5_000, [10_000, 9_990, 10_030], [10_000])
    began = time.perf_counter()
    pieces = drift._transfer_pieces(0, 2 * gap, expected, units, rule)
    assert time.perf_counter() - began < 5
    assert len(pieces) < 3 * len(expected)
    named = [{"low": a, "high": b, "steps": [dict(zip(("kind", "a", "m"), s, strict=True)) for s in o]} for a, b, o in pieces]
    for start in [rng.randrange(2 * gap) for _ in range(20)]:
        assert drift._follow(named, start) == rule.advance_all(start, expected, units)


def _leads(spark, data):
    return spark.createDataFrame(
        [("s", us, i, lead, us) for i, (us, lead) in enumerate(data)],
        "session_id string, us bigint, seq bigint, lead_us bigint, elapsed_us bigint",
    )


def _last_drift(spark, left, right, hot_rows=None):
    out = drift.relative_drift(_leads(spark, left), _leads(spark, right), hot_rows=hot_rows)
    return out.orderBy(F.desc("us"), F.desc("side")).first()["drift_us"]


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_relative_drift(spark, hot_rows):
    second = 1_000_000
    assert _last_drift(spark, [(100, -5000)], [(200, -45_000)], hot_rows) == 0
    steady = [(k * second, -5000) for k in range(1, 5)], [(k * second, -45_000) for k in range(1, 5)]
    assert _last_drift(spark, *steady, hot_rows) == 0
    moved = [(k * second, 1) for k in range(1, 5)], [(k * second, 1 if k < 4 else 30_001) for k in range(1, 5)]
    assert _last_drift(spark, *moved, hot_rows) == 30_000


def test_asof_needs_no_update_at_the_same_time(observe):
    left, right = observe([("a", 0, 10, 1), ("a", 1, 30, 2)]), observe([("b", 2, 20, 7), ("b", 3, 30, 8)])
    out = align.asof_latest(left, right)
    assert rows(out, "us", "side", "latest_left", "latest_right") == [
        (10, 0, 1.0, None), (20, 1, 1.0, 7.0), (30, 0, 2.0, 7.0), (30, 1, 2.0, 8.0),
    ]


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_segments(observe, hot_rows):
    data = [("a", i, us, 0) for i, us in enumerate([0, 10, 20, 100, 110, 400])]
    out = drift.segment_by_gap(observe(data), F.lit(10), 5, hot_rows=hot_rows)
    assert rows(out, "us", "segment", "discontinuity") == sorted(
        [(0, 0, False), (10, 0, False), (20, 0, False), (100, 1, True), (110, 1, False), (400, 2, True)], key=repr
    )


def test_extents(observe):
    a = observe([("a", 0, 0, 0), ("a", 1, 1000, 0), ("b", 2, 5, 0), ("b", 3, 1080, 0)])
    out = align.compare_extents(align.stream_extents(a), 10, 80)
    assert rows(out, "streams", "start_gap_us", "length_gap_us", "starts_agree", "lengths_agree") == [
        (2, 5, 75, True, True)
    ]
