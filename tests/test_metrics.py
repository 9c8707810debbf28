from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamgrid.functions.lookups import constant_table
from streamgrid.operators import audit, merge, metrics, planning, rules, verdict


def test_latency_summary_uses_nearest_rank(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("k"), F.col("id").alias("us"))
    out = metrics.latency_summary(df, "us", ["k"])
    assert rows(out, "count", "mean_us", "p50_us", "p99_us", "max_us") == [(1000, 500.5, 500, 990, 1000)]


def test_latencies_above_a_bound_are_counted_apart(spark):
    data = [("a", -5), ("a", 0), ("a", 60_000_000), ("a", 60_000_001), ("b", 70_000_000), (None, 7)]
    df = spark.createDataFrame(data, "k string, us bigint")
    out = metrics.latency_summary(df, "us", ["k"], 60_000_000)
    found = rows(out, "k", "count", "p50_us", "max_us", "out_of_range")
    assert found == sorted([("a", 3, 1, 60_000_000, 1), ("b", 0, None, None, 1), (None, 1, 7, 7, 0)], key=repr)
    everything = rows(metrics.latency_summary(df, "us", ["k"]), "k", "count", "max_us", "out_of_range")
    assert everything == sorted([("a", 4, 60_000_001, 0), ("b", 1, 70_000_000, 0), (None, 1, 7, 0)], key=repr)
    bounded = metrics.latency_histogram(df, "us", ["k"], 60_000_000)
    assert rows(bounded.filter("k = 'b'"), "bucket_low", "bucket_high", "rows") == [(60_000_001, None, 1)]


def test_latency_summary_over_value_ranges(spark):
    rng = random.Random(9)
    data = [(rng.choice("aaab"), int(rng.paretovariate(0.6)) * 97 % 50_000_000 + 1) for _ in range(600)]
    df = spark.createDataFrame(data, "k string, us bigint")
    for r in metrics.latency_summary(df, "us", ["k"]).collect():
        ranked = sorted(v for k, v in data if k == r["k"])
        n = len(ranked)
        assert (r["count"], r["max_us"]) == (n, ranked[-1])
        assert (r["p50_us"], r["p99_us"]) == (ranked[-(-n // 2) - 1], ranked[-(-99 * n // 100) - 1])


def test_a_take_at_the_instant_of_its_offer_finds_it(spark):
    data = [("s", 10, -1, 1), ("s", 10, 1, 1), ("s", 12, 1, 2), ("s", 12, -1, 2)]
    df = spark.createDataFrame(data, "session_id string, us bigint, delta int, seq bigint")
    assert rows(metrics.occupancy(df, 5), "us", "delta", "inflight") == [(10, -1, 0), (10, 1, 1), (12, -1, 0), (12, 1, 1)]


def test_histogram_keeps_three_digits_and_merges(spark):
    df = spark.range(1, 200_000, 7).select((F.col("id") % 2).alias("shard"), F.col("id").alias("us"))
    parts = metrics.latency_histogram(df, "us", ["shard"])
    merged = metrics.merge_histograms(parts, [])
    whole = metrics.latency_histogram(df, "us", [])
    columns = ["bucket_low", "bucket_high", "rows"]
    assert rows(merged, *columns) == rows(whole, *columns)
    width = (F.col("bucket_high") - F.col("bucket_low")) / F.col("bucket_low")
    assert whole.agg(F.max(width)).first()[0] < 0.001


def test_rates(spark):
    df = spark.createDataFrame(
        [("s", "a", 1_000_000, 0, 0), ("s", "a", 2_000_000, 60, 1_000_000), ("s", "a", 3_000_000, 10, 1_000_000)],
        "session_id string, stream_id string, at_us bigint, n bigint, bytes bigint",
    )
    out = metrics.rates(df, ["n", "bytes"], size="bytes")
    assert rows(out, "at_us", "n_per_sec", "bytes_bits_per_sec") == [
        (1_000_000, None, None), (2_000_000, 60.0, 8_000_000.0), (3_000_000, 0.0, 0.0),
    ]


def test_losses(spark):
    board = constant_table(spark, ["filled", "dropped_queue", "late", "skipped", "disk_write_lag"], [(10, 2, 1, 4, 0)])
    assert rows(metrics.loss_accounting(board), "lost", "any_overrun") == [(6, False)]


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_bounded_queue_matches_a_loop(spark, hot_rows):
    rng = random.Random(4)
    log, length, overflow, expected = [], 0, 0, []
    for seq in range(150):
        take = length > 0 and rng.random() < 0.4
        if take:
            length -= 1
        elif length == 5:
            overflow += 1
        else:
            length += 1
        log.append(("s", seq, -1 if take else 1, seq))
        expected.append((seq, length, overflow))
    df = spark.createDataFrame(log, "session_id string, us bigint, delta int, seq bigint")
    out = metrics.occupancy(df, 5, hot_rows=hot_rows)
    assert rows(out, "seq", "length", "overflow") == sorted(expected, key=repr)


def test_full_queue_drops_the_newest(spark):
    df = spark.createDataFrame([("s", i, 1, i) for i in range(5)], "session_id string, us bigint, delta int, seq bigint")
    last = metrics.occupancy(df, 2).orderBy(F.desc("us")).first()
    assert (last["length"], last["overflow"], last["inflight"]) == (2, 3, 5)


def test_verdicts(spark):
    board = constant_table(
        spark, ["emitted_per_sec", "target", "lost"], [(60.0, 60, 5), (60.0, 60, 0), (58.5, 60, 0), (20.0, 60, 0)]
    )
    out = verdict.verdict(board)
    assert rows(out, "emitted_per_sec", "lost", "sustained", "summary_met") == sorted(
        [(60.0, 5, False, True), (60.0, 0, True, True), (58.5, 0, False, True), (20.0, 0, False, False)], key=repr
    )


def test_diagnosis_default_and_order(spark):
    columns = ["session_id", "encoder_overload", "skipped", "hardware", "intake_overrun", "disk_write_lag",
               "received_per_sec", "target", "lost"]
    board = constant_table(spark, columns, [("a", 0, 0, True, 0, 0, 60.0, 60, 0), ("b", 1, 3, False, 2, 0, 10.0, 60, 3),
                                            ("c", 0, 0, True, 0, 0, 10.0, 60, 0)])
    causes = dict(rows(verdict.diagnosis(board), "session_id", "causes"))
    assert causes["a"] == ["source_limited_default"]
    assert causes["b"] == ["encoder_bottleneck", "software_encoder", "intake_queue_overflow"]
    assert causes["c"] == ["source_too_slow"]


def test_streaks_need_consecutive_failures(observe):
    data = [("a", i, i, 0 if i == 5 else 1) for i in range(15)]
    for hot_rows in (None, 4):
        out = merge.failure_streaks(observe(data), F.col("value") == 1, hot_rows=hot_rows)
        assert rows(out, "failures", "from_us", "to_us") == [(5, 0, 4), (9, 6, 14)]


def test_interleave_is_a_total_order(spark):
    def packets(pts, den):
        df = spark.createDataFrame([("s", i, p) for i, p in enumerate(pts)], "session_id string, seq bigint, pts bigint")
        return df.withColumn("dts", F.col("pts")), (1, den)

    out = merge.interleave(packets([0, 1, 2], 60), packets([0, 16_667, 40_000], 1_000_000)).collect()
    assert [(r["dts"], r["stream_index"]) for r in out] == [
        (0, 0), (0, 1), (16_667, 0), (16_667, 1), (33_333, 0), (40_000, 1),
    ]


def test_grid_audit_tolerance(observe):
    df = observe([("a", 0, 0, 0), ("a", 1, 1000, 0), ("a", 2, 2999, 0)]).withColumn("slot", F.col("seq"))
    out = audit.grid_check(df, F.col("us"), 1000, 999)
    assert rows(out, "intervals", "irregular", "grid_ok") == [(2, 1, False)]


def _candidates(spark, codec="h264", vendor="intel", policy="auto", forced=""):
    req = constant_table(spark, ["request_id", "codec", "vendor", "policy", "forced_name"],
                         [(1, codec, vendor, policy, forced)])
    return [r["name"] for r in planning.rank_candidates(req).orderBy("rank").collect()]


def test_ranking(spark):
    assert _candidates(spark)[:2] == ["h264_vaapi", "h264_qsv"]
    assert _candidates(spark, vendor="nvidia")[0] == "h264_nvenc"
    assert not any(n.startswith("lib") for n in _candidates(spark, policy="force"))
    assert _candidates(spark, codec="av1", policy="off") == ["libsvtav1", "librav1e", "libaom-av1", "libx264"]
    assert _candidates(spark, forced="hevc_nvenc") == ["hevc_nvenc"]
    for vendor in planning.VENDOR_INTERFACES:
        names = _candidates(spark, codec="hevc", vendor=vendor)
        assert len(names) == len(set(names))


def test_bitrate_plan(spark):
    columns = ["id", "width", "height", "fps", "codec", "quality", "bitrate", "rate_control"]
    data = [(1, 2560, 1440, 60, "h264", "high", 35_000_000, "vbr"), (2, 2560, 1440, 60, "h264", "high", 0, "cbr"),
            (3, 1920, 1080, 60, "h264", "high", 0, "cq"), (4, 1920, 1080, 30, "h264", "high", 0, "vbr"),
            (5, 1920, 1080, 60, "hevc", "high", 0, "vbr"), (6, 15, 9, 30, "av1", "low", 0, "vbr")]
    got = {r["id"]: r for r in planning.plan_bitrate(constant_table(spark, columns, data)).collect()}
    rate = {i: r["planned_bitrate"] for i, r in got.items()}
    assert rate[1] == 35_000_000 and got[1]["max_bitrate"] == 52_500_000
    assert rate[2] > rate[3] > rate[4] and rate[5] < rate[3]
    assert got[3]["quantiser"] == 23 and got[3]["max_bitrate"] is None
    assert rate[6] == 1_000_000 and not got[6]["size_ok"]


def test_first_success_lists_failures_before_it(spark):
    data = [
        (1, 1, "a", "h264", "h264", False, "x"), (1, 2, "b", "h264", "av1", True, None), (1, 3, "c", "h264", "h264", False, "z"),
        (2, 1, "a", "h264", "h264", False, "x"),
        (3, 1, "a", "h264", "h264", False, "x"), (3, 2, "b", "h264", "h264", True, None),
    ]
    columns = ["request_id", "rank", "name", "codec", "candidate_codec", "ok", "err"]
    out = planning.first_success(constant_table(spark, columns, data))
    # Another name for the codec asked for is no fallback.
    assert rows(out, "request_id", "name", "opened", "fallback", "failures") == [
        (1, "b", True, True, ["a (x)"]), (2, None, False, None, ["a (x)"]), (3, "b", True, False, ["a (x)"]),
    ]


def test_all_broken_rules_are_reported_and_warnings_are_separate(spark):
    columns = ["output_format", "video_codec", "output_fragmented"]
    risky = constant_table(spark, columns, [("mp4", "av1", False), ("mp4", "av1", True)])
    warned = rules.validate(risky, rules.config_warnings())
    assert sorted(len(r["violations"]) for r in warned.collect()) == [0, 1]
    assert len(rules.config_rules()) == 20


def test_overrides(spark):
    base = constant_table(spark, ["id"], [(1,), (2,), (3,)])
    weak = constant_table(spark, ["id", "a"], [(1, "w"), (2, "w")])
    strong = constant_table(spark, ["id", "a"], [(1, "s"), (2, None)])
    out = rules.layered_overrides(base, "id", [weak, strong], {"a": "d"})
    assert rows(out, "id", "a") == [(1, "s"), (2, "w"), (3, "d")]


def test_missing_latencies_are_not_fast_ones(spark):
    df = spark.createDataFrame([("a", None), ("a", 500), ("a", 700), ("b", None)], "k string, us bigint")
    found = rows(metrics.latency_summary(df, "us", ["k"]), "k", "count", "mean_us", "p50_us", "max_us", "out_of_range", "missing")
    assert found == [("a", 2, 600.0, 500, 700, 0, 1), ("b", 0, None, None, None, 0, 1)]
    bounded = rows(metrics.latency_summary(df, "us", ["k"], 600), "k", "count", "out_of_range", "missing")
    assert bounded == [("a", 1, 1, 1), ("b", 0, 0, 1)]
    for bound in (None, 600):
        histogram = rows(metrics.latency_histogram(df, "us", ["k"], bound), "k", "bucket_low", "rows")
        assert histogram == [("a", 500, 1), ("a", 700 if bound is None else 601, 1)]
