from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.operators import blocks


@pytest.fixture
def chunks(spark):
    def make(sizes, channels=1, t0=0):
        data, at = [], 0
        for i, n in enumerate(sizes):
            data.append(("s", "a", i, i * 1000, channels, [float(at + k) for k in range(n * channels)], t0))
            at += n * channels
        schema = "session_id string, stream_id string, seq bigint, us bigint, channels int, samples array<float>, t0 bigint"
        return spark.createDataFrame(data, schema)

    return make


def test_hundred_chunks_give_46_blocks_and_a_rest(chunks):
    out = blocks.reblock(chunks([480] * 100))
    counts = out.groupBy("is_partial", "frames").count()
    assert rows(counts, "is_partial", "frames", "count") == [(False, 1024, 46), (True, 896, 1)]
    assert [r[0] for r in out.orderBy("block").select("pts").collect()] == [k * 1024 for k in range(47)]


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_reblocking_keeps_every_sample_in_order(chunks, hot_rows):
    rng = random.Random(1)
    sizes = [rng.randrange(0, 40) for _ in range(60)]
    out = blocks.reblock(chunks(sizes, channels=2), 7, hot_rows=hot_rows).orderBy("block").collect()
    assert [x for r in out for x in r["samples"]] == [float(i) for i in range(2 * sum(sizes))]
    assert all(r["frames"] == 7 for r in out[:-1])


def test_leading_trim_drops_whole_and_cuts_partial_chunks(chunks):
    out = blocks.leading_trim(chunks([4, 4, 4], channels=2, t0=1500), 4000)
    assert rows(out, "seq", "skipped", "samples") == [
        (1, 2, [12.0, 13.0, 14.0, 15.0]), (2, 0, [float(x) for x in range(16, 24)]),
    ]


def test_head_drop_is_limited_to_the_chunk(chunks):
    out = blocks.head_drop(chunks([3]).withColumn("excess", F.lit(9)), "excess")
    assert rows(out, "dropped", "samples") == [(3, [])]


@pytest.mark.parametrize("spread", [1, 3, 4096])
def test_fill_blocks(spark, spread):
    df = spark.createDataFrame([(1, 2500), (2, 0), (3, 1024)], "id int, missing bigint")
    out = blocks.fill_blocks(df, "missing", spread=spread)
    assert rows(out, "id", "block", "units") == [(1, 0, 1024), (1, 1, 1024), (1, 2, 452), (3, 0, 1024)]
    assert out.select(F.size(blocks.silence(F.col("units"), F.lit(2))).alias("n")).agg(F.sum("n")).first()[0] == 7048


def test_deinterleave(spark):
    df = spark.range(1).select(blocks.deinterleave(F.array(*[F.lit(float(i)) for i in range(6)]), 2).alias("p"))
    assert df.first()["p"] == [[0.0, 2.0, 4.0], [1.0, 3.0, 5.0]]
