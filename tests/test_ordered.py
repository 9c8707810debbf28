"""Split scans give what one window per stream gives."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.operators import ordered as o
from streamgrid.operators.joins import lookup_join


def _scans():
    return {
        "total": o.running_sum("v"),
        "before": o.running_sum("v", inclusive=False),
        "top": o.running_max("v"),
        "top_before": o.running_max("v", inclusive=False),
        "latest": o.last_value("v"),
        "latest_before": o.last_value("v", inclusive=False),
        "first": o.first_value("v"),
        "prev": o.lag("v"),
        "next": o.lead("v"),
        "rank": o.row_number(),
    }


@pytest.fixture(scope="module")
def skewed(spark):
    """One stream holds most rows, a third of all rows share one timestamp, and values may be null."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        stream = "hot" if rng.random() < 0.8 else rng.choice("abc")
        us = 500 if rng.random() < 0.4 else rng.randrange(1000)
        data.append(("s", stream, us, i, None if rng.random() < 0.3 else rng.randrange(-50, 50)))
    return spark.createDataFrame(data, "session_id string, stream_id string, us bigint, seq bigint, v bigint")


KEYS, ORDER = ["session_id", "stream_id"], ["us", "seq"]


def test_range_split_equals_plain_windows(skewed):
    plain = o.ordered(skewed, KEYS, ORDER)
    split = o.ordered(skewed, KEYS, ORDER, hot_rows=40)
    assert not plain.split and split.split
    columns = [*KEYS, *ORDER, *_scans()]
    assert rows(plain.scan(**_scans()).result(), *columns) == rows(split.scan(**_scans()).result(), *columns)


def test_hot_stream_is_spread_over_parts(skewed):
    split = o.ordered(skewed, KEYS, ORDER, hot_rows=40)
    sizes = [r["count"] for r in split.parted().groupBy(*KEYS, o.PART).count().collect()]
    assert max(sizes) < 150 and len(sizes) > 15


def test_cuts_grow_with_the_rows_and_not_with_a_low_bound(spark):
    assert o.cuts_for(900, 40) == 45
    assert o.cuts_for(6_000_000, 100) == 64 and o.cuts_for(36_000_000, 10) == 360
    assert o.cuts_for(36_000_000, o.HOT_ROWS) == 18
    df = spark.range(4_000).select(F.lit("s").alias("session_id"), F.lit("a").alias("stream_id"), F.col("id").alias("us"), F.col("id").alias("seq"))
    split = o.ordered(df, KEYS, ORDER, hot_rows=10)
    assert 32 < split.parted().select(o.PART).distinct().count() <= o.LEAST_CUTS
    assert split.scan(rank=o.row_number()).result().filter("rank = us + 1").count() == 4_000


def test_given_parts_and_chained_scans(skewed):
    def chain(df, **kw):
        scan = o.ordered(df, KEYS, ORDER, **kw).scan(prev=o.lag("us")).with_columns(gap=F.col("us") - F.col("prev"))
        return rows(scan.scan(gaps=o.running_sum("gap")).result(), *KEYS, *ORDER, "prev", "gaps")

    assert chain(skewed) == chain(skewed, part=F.floor(F.col("us") / 100))


def test_null_stream_keys_are_refused(spark):
    df = spark.createDataFrame([(None, "a", 1, 1, 1)], "session_id string, stream_id string, us bigint, seq bigint, v bigint")
    with pytest.raises(ValueError, match="must not be null"):
        o.ordered(df, KEYS, ORDER)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_broadcast(spark, skewed, how):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "stream_id string, w int")
    small = lookup_join(skewed, lookup, ["stream_id"], how, spread_by=["seq"])
    large = lookup_join(skewed, lookup, ["stream_id"], how, spread_by=["seq"], max_rows=1, salts=8)
    plain = skewed.join(lookup, "stream_id", how)
    columns = ["stream_id", "seq", "w"]
    assert rows(small, *columns) == rows(large, *columns) == rows(plain, *columns)
