from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from streamgrid.functions import scalars


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("n", "d", "expected"), [(10, 4, 3), (-10, 4, -3), (2, 4, 1), (1, 4, 0)])
def test_div_round(spark, n, d, expected):
    assert value(spark, scalars.div_round(n, d)) == expected


@pytest.mark.parametrize(("n", "d"), [(7, 3), (-7, 3), (6, 3), (-6, 3), (0, 5)])
def test_floor_and_ceil(spark, n, d):
    assert value(spark, scalars.floor_div(n, d)) == n // d
    assert value(spark, scalars.ceil_div(n, d)) == -(-n // d)


def test_deadlines_are_exact(spark):
    period = 16_666
    slots = spark.range(216_001).select((scalars.deadline_of("id", F.lit(123), period) - F.col("id") * period).alias("d"))
    assert [r[0] for r in slots.distinct().collect()] == [123]


def test_rescale_survives_large_values(spark):
    big = 9_000_000_000_000_000_000
    assert value(spark, scalars.rescale_ts(F.lit(big), 1, 1_000_000, 1, 1000)) == 9_000_000_000_000_000
    assert value(spark, scalars.rescale_ts(F.lit(3), 1, 60, 1, 1_000_000)) == 50_000


def test_latency_is_clamped(spark):
    assert value(spark, scalars.clamped_latency_us(500, 1000)) == 0
    assert value(spark, scalars.clamped_latency_us(5_000, 1000)) == 4


@pytest.mark.parametrize(("size", "channels", "expected"), [(960, 2, 480), (960, 1, 960), (960, 0, 0)])
def test_frames(spark, size, channels, expected):
    assert value(spark, scalars.frames_of(F.array_repeat(F.lit(0.0), size), channels)) == expected


@pytest.mark.parametrize(
    ("fn", "given", "text"),
    [
        (scalars.format_duration, 83, "0:01:23"),
        (scalars.format_duration, 3661, "1:01:01"),
        (scalars.format_duration, -5, "0:00:00"),
        (scalars.format_bitrate, 35_000_000, "35.0 Mb/s"),
        (scalars.format_bitrate, 128_000, "128 kb/s"),
        (scalars.format_bitrate, 12, "12 b/s"),
        # In the middle between two texts the double decides: 1.15 lies below it, 2.45 above, 2.25 and 2.5 on it.
        (scalars.format_bitrate, 1_150_000, "1.1 Mb/s"),
        (scalars.format_bitrate, 2_450_000, "2.5 Mb/s"),
        (scalars.format_bitrate, 2_250_000, "2.2 Mb/s"),
        (scalars.format_bitrate, 999_950_000_000, "999950.0 Mb/s"),
        (scalars.format_bitrate, 2_500, "2 kb/s"),
        (scalars.format_bitrate, 3_500, "4 kb/s"),
        (scalars.format_bytes, 1536, "1.5 Kio"),
        (scalars.format_bytes, 12, "12 o"),
        (scalars.format_bytes, 5 * 1024**4, "5120.0 Gio"),
    ],
)
def test_formats(spark, fn, given, text):
    assert value(spark, fn(F.lit(given))) == text


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a/b.mp4", "a/b.mkv"), ("a/b.MKV", "a/b.MKV"), ("a.d/b", "a.d/b.mkv"), ("x/.hidden", "x/.hidden.mkv"), ("b.", "b.mkv")],
)
def test_extension(spark, path, expected):
    assert value(spark, scalars.align_extension(F.lit(path), "mkv")) == expected


def test_gop_and_even(spark):
    assert value(spark, scalars.gop_size(2.0, 60)) == 120
    assert value(spark, scalars.gop_size(2.0, 30)) == 60
    assert value(spark, scalars.gop_size(0.001, 30)) == 1
    assert value(spark, scalars.force_even(F.lit(641))) == 640


def test_errors(spark):
    assert value(spark, scalars.classify_error(F.lit("write"), F.lit(28))) == "disk_full"
    assert value(spark, scalars.classify_error(F.lit("write"), F.lit(5))) == "disk_write"
    assert value(spark, scalars.is_fatal(F.lit("mux"))) and not value(spark, scalars.is_fatal(F.lit("encode")))
    assert not value(spark, scalars.is_failure(F.lit("eof")))


def test_missing_times_stay_missing(spark):
    none = F.lit(None).cast("bigint")
    assert value(spark, scalars.clamped_latency_us(none, 1)) is None
    assert value(spark, scalars.clamped_latency_us(F.lit(1), none)) is None
    assert value(spark, scalars.saturate_non_negative(none)) is None
    assert value(spark, scalars.format_duration(none)) is None
