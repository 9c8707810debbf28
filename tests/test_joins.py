"""Lookups: literal, broadcast, or written and salted, by rows and by bytes; bounds of a grid with late rows."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.operators import grid, joins
from streamgrid.operators.origin import attach_origin, common_origin, trim_pre_origin
from streamgrid.plans.regularise import regularise, slotted_with_bound


@pytest.mark.parametrize(("limit", "local"), [(32 * 1024**2, True), (64, False)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookups_of_any_size_give_the_same_rows(spark, monkeypatch, limit, local, how):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    big = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    lookup = spark.range(5).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    small = joins.bounded(lookup)
    assert small.is_local == local
    found = joins.lookup_join(big, small, ["k"], how, spread_by=["id"], salts=4)
    want = [(i % 7, i, f"v{i % 7}" if i % 7 < 5 else None) for i in range(300) if how == "left" or i % 7 < 5]
    assert rows(found, "k", "id", "v") == sorted(want, key=repr)


def test_one_row_becomes_literals_and_none_an_empty_table(spark):
    big = spark.range(4).withColumnRenamed("id", "k")
    one = spark.createDataFrame([(2, None)], "k bigint, v string")
    assert rows(joins.lookup_join(big, one, ["k"]), "k", "v") == [(2, None)]
    assert joins.lookup_join(big, one.limit(0), ["k"]).count() == 0
    assert rows(joins.lookup_join(big, one.limit(0), ["k"], "left"), "k", "v") == [(i, None) for i in range(4)]


def test_late_rows_have_a_bound_and_the_same_grid(observe):
    rng, us, data = random.Random(2), 0, []
    for i in range(200):
        us += rng.choice([100, 900, 1100, 5000])
        data.append((rng.choice("ab"), i, us, i, us + rng.choice([0, 500, 9000, 40_000])))
    seen = observe(data).drop("t0")
    slots, bound = slotted_with_bound(seen, 1000, lookahead_us=700)
    assert slots.groupBy("session_id", "stream_id").count().agg(F.max("count")).first()[0] <= bound
    assert slots.agg(F.max("slot")).first()[0] < bound
    kept = trim_pre_origin(attach_origin(seen, common_origin(seen)))
    late = grid.reslot_late(grid.assign_slots(kept, 1000), 1000, 700)
    want = grid.fill_gaps(grid.coalesce_slots(late, by_arrival=True), 5)
    columns = ["stream_id", "slot", "slot_to", "status", "us", "seq", "superseded", "late", "lost"]
    assert rows(regularise(seen, 1000, 5, lookahead_us=700), *columns) == rows(want, *columns)
