from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.operators import grid, origin
from streamgrid.plans.regularise import regularise

P = 100


def _filled(df, period=P, max_fill=None, end_slot=None, anchor="origin", **kw):
    slots = grid.coalesce_slots(grid.assign_slots(df, period, anchor))
    return grid.fill_gaps(slots, max_fill, end_slot, **kw)


def test_jitter_is_absorbed(observe):
    data = [("a", 0, 0, 0)] + [("a", k, k * P + (40 if k % 2 else -40), k) for k in range(1, 50)]
    assert rows(_filled(observe(data)), "slot", "status") == sorted([(k, "fresh") for k in range(50)], key=repr)


def test_two_rows_in_a_slot_keep_the_newer(observe):
    out = grid.coalesce_slots(grid.assign_slots(observe([("a", 1, 0, 1), ("a", 2, P // 10, 2)]), P))
    assert rows(out, "slot", "value", "superseded") == [(0, 2.0, 1)]


def test_late_row_moves_to_the_next_open_slot(observe):
    df = observe([("a", 0, 0, 0, 0), ("a", 1, 10, 1, 30), ("a", 2, 20, 2, 31), ("a", 3, 30, 3, 131)])
    late = grid.reslot_late(grid.assign_slots(df, P), P, lookahead_us=30)
    # Arrival exactly at the deadline is in time.
    assert rows(late, "seq", "slot", "late") == [(0, 0, False), (1, 0, False), (2, 1, True), (3, 2, True)]


def test_grid_end_repeats_the_last_row(observe):
    out = _filled(observe([("a", 0, 0, 5)]), end_slot=9)
    expected = [(0, "fresh", 5.0)] + [(k, "filled", 5.0) for k in range(1, 10)]
    assert rows(out, "slot", "status", "value") == sorted(expected, key=repr)


def test_long_gap_is_skipped_and_counted(observe):
    out = _filled(observe([("a", 0, 0, 1), ("a", 1, 180 * P, 2)]), max_fill=60)
    assert rows(out.filter("status = 'skipped'"), "slot", "slot_to", "lost", "value") == [(1, 179, 179, None)]
    counts = grid.status_counts(out)
    assert rows(counts, "fresh", "filled", "skipped", "overloads", "slots") == [(2, 0, 179, 1, 181)]


def test_gap_within_the_bound_is_filled(observe):
    out = _filled(observe([("a", 0, 0, 1), ("a", 1, 50 * P, 2)]), max_fill=60)
    assert rows(grid.status_counts(out), "filled", "skipped") == [(49, 0)]


def test_anchor_first(observe):
    out = grid.assign_slots(observe([("a", 0, 123_456, 1)], t0=0), P, anchor="first")
    assert rows(out, "slot") == [(0,)]


@pytest.mark.parametrize(("part_slots", "fill_block"), [(1, 1), (3, 2), (1000, 7)])
def test_parts_and_blocks_do_not_change_the_result(observe, part_slots, fill_block):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.randrange(0, 20_000), i) for i in range(60)]
    columns = ["stream_id", "slot", "slot_to", "status", "value", "superseded", "lost"]
    for max_fill in (None, 2):
        whole = _filled(observe(data), max_fill=max_fill)
        cut = _filled(observe(data), max_fill=max_fill, part_slots=part_slots, fill_block=fill_block)
        assert rows(whole, *columns) == rows(cut, *columns)


def test_fill_matches_a_loop(observe):
    rng = random.Random(5)
    data = [("a", i, rng.randrange(0, 50_000), i) for i in range(80)]
    best = {}
    for _, seq, us, value in data:
        best[(us + P // 2) // P] = max(best.get((us + P // 2) // P, (-1,)), (us, seq, float(value)))
    expected, last = [], None
    for slot in range(min(best), max(best) + 1):
        last = best.get(slot, last)
        expected.append((slot, "fresh" if slot in best else "filled", last[2]))
    assert rows(_filled(observe(data)), "slot", "status", "value") == sorted(expected, key=repr)


def test_regularise_is_idempotent_and_ignores_input_order(observe):
    rng = random.Random(11)
    data = [(rng.choice("ab"), i, rng.randrange(0, 9_000), i) for i in range(50)]
    columns = ["stream_id", "slot", "value"]
    once = regularise(observe(data).drop("t0"), P)
    shuffled = regularise(observe(rng.sample(data, len(data))).drop("t0").repartition(7), P)
    assert rows(once, *columns) == rows(shuffled, *columns)
    # The grid of a grid is the grid itself.
    t0 = origin.common_origin(observe(data).drop("t0")).first()["t0"]
    again = once.withColumn("us", F.lit(t0) + F.col("slot") * P).withColumn("seq", F.col("slot"))
    again = again.withColumn("arrival_us", F.col("us"))
    twice = _filled(again.withColumn("t0", F.lit(t0)).select(*observe(data).drop("ts").columns))
    assert rows(twice, *columns) == rows(once, *columns)


def test_variable_rate_matches_a_loop(observe):
    rng = random.Random(2)
    data = [("a", i, rng.randrange(100), i, rng.randrange(100)) for i in range(80)]
    kept, last = [], None
    for _, seq, us, _, _arrival in sorted(data, key=lambda r: (r[4], r[1])):
        if last is None or us > last:
            kept.append((seq, us))
            last = us
    assert rows(grid.monotonic_thin(observe(data)), "seq", "tick") == sorted(kept, key=repr)
    assert rows(grid.monotonic_thin(observe(data), hot_rows=10), "seq", "tick") == sorted(kept, key=repr)


def test_caps(observe):
    data = [("a", i, i * 10, i) for i in range(30)]
    assert grid.cap_rows(observe(data), 4).count() == 4
    assert "WindowGroupLimit" in grid.cap_rows(observe(data), 4)._jdf.queryExecution().toString()
    assert grid.cap_duration(observe(data, t0=0), 55).count() == 6


def test_common_origin(spark, observe):
    def t0(data, **kw):
        return origin.common_origin(observe(data).drop("t0"), **kw).first()["t0"]

    assert t0([("a", 0, 1000, 0)]) == 1000
    assert t0([("a", 0, 1000, 0), ("b", 1, 5000, 0)]) == 5000
    withdrawn = spark.createDataFrame([("s", "b")], "session_id string, stream_id string")
    assert t0([("a", 0, 7000, 0), ("b", 1, 9000, 0)], withdrawn=withdrawn) == 7000
    assert t0([("a", 0, 4000, 0), ("b", 1, 90_000, 0)], timeout_us=10_000) == 4000


def test_null_streams_are_refused_whatever_the_size(observe):
    from streamgrid.operators import ordered as o

    df = observe([(None, 0, 0, 1), ("a", 1, 5, 2)])
    for bound in (10, None):
        with pytest.raises(Exception, match="must not be null"):
            o.ordered(df, ["session_id", "stream_id"], ["us", "seq"], rows_bound=bound).scan(n=o.row_number()).result().collect()


def test_conservation_counts_rejected_rows(observe, spark):
    from streamgrid.operators import audit, origin
    from streamgrid.plans.regularise import regularise

    good = observe([("a", 0, 0, 1), ("a", 1, 10, 2)]).drop("t0")
    raw = good.unionByName(good.withColumn("session_id", F.lit(None).cast("string")))
    seen = origin.attach_origin(raw, origin.common_origin(good), "left")
    out = audit.conservation(seen, regularise(good, 5, max_fill=2))
    found = rows(out, "session_id", "observations", "rejected", "rows_conserved")
    assert found == sorted([("s", 2, 0, True), (None, 2, 2, True)], key=repr)


def test_slots_are_combined_by_hash_whatever_the_ties(observe):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice([i % 7, -(2**63), 2**63 - 1, i]), rng.choice([0, 5, 10, 15, -5, 10**17]), i) for i in range(300)]
    slotted = grid.assign_slots(observe(data), 10)
    out = grid.coalesce_slots(slotted)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
    best = {}
    for stream, seq, us, value in data:
        slot = (us + 5) // 10 if us >= 0 else -((-us + 5) // 10)
        best[stream, slot] = max(best.get((stream, slot), (us, seq, -1.0)), (us, seq, float(value)))
    found = {(r["stream_id"], r["slot"]): (r["us"], r["seq"]) for r in out.collect()}
    assert found == {k: v[:2] for k, v in best.items()}
