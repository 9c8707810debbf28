"""Rule tables over configuration rows, unknown keys and layered overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``broken`` is true for a bad row; a null condition does not break a rule."""

    name: str
    broken: Column
    message: str


def outside(column: str, low: float, high: float) -> Column:
    return ~F.col(column).between(low, high)


# Accepted sample rates and the name parts of hardware encoders.
SAMPLE_RATES = (8_000, 16_000, 22_050, 32_000, 44_100, 48_000)
HARDWARE_NAMES = ("vaapi", "qsv", "nvenc", "amf", "videotoolbox", "mf")
# Rule, column, lowest and highest accepted value (None: no bound).
BOUNDS = [
    ("fps_bounds", "video_fps", 1, 480),
    ("fps_minimum", "video_fps", 30, None),
    ("keyframe_interval", "video_keyframe_secs", 0.1, 60.0),
    ("b_frames", "video_b_frames", None, 16),
    ("lookahead", "video_lookahead_ms", None, 1000),
    ("convert_threads", "video_convert_threads", None, 64),
    ("writer_buffer", "output_buffer_kb", 64, 262_144),
    ("video_queue", "queue_video", 2, 240),
    ("audio_queue", "queue_audio", 2, 4096),
    ("packet_queue", "queue_packet", 8, 8192),
]
# The same for what counts only if there is audio.
AUDIO_BOUNDS = [
    ("channels", "audio_channels", 1, 2),
    ("audio_bitrate", "audio_bitrate", 32_000, 512_000),
    ("fragment", "audio_fragment_ms", 1, 100),
    ("max_drift", "audio_max_drift_ms", 10, 5000),
]
# Bounds of a bit rate that is not left to the library (0), and slots beyond the queue.
BITRATE_BOUNDS = (100_000, 500_000_000)
SPARE_FRAMES = 2


def _bounded(name: str, column: str, low: float | None, high: float | None, only_if: Column | None = None) -> Rule:
    below = F.lit(False) if low is None else F.col(column) < low
    above = F.lit(False) if high is None else F.col(column) > high
    broken = below | above
    limits = [f"at least {low}"] * (low is not None) + [f"at most {high}"] * (high is not None)
    return Rule(name, broken if only_if is None else only_if & broken, f"{column} has to be {' and '.join(limits)}")


def config_rules() -> list[Rule]:
    """Bounds, enums and cross-field rules of a recording configuration (flat ``section_field`` columns)."""
    audio = F.col("audio_enabled")
    hardware_name = F.lit(False)
    for part in HARDWARE_NAMES:
        hardware_name = hardware_name | F.contains(F.col("video_encoder"), F.lit(part))
    rates = ", ".join(map(str, SAMPLE_RATES))
    return [
        *[_bounded(*bound) for bound in BOUNDS],
        *[_bounded(*bound, audio) for bound in AUDIO_BOUNDS],
        _bounded("video_bitrate", "video_bitrate", *BITRATE_BOUNDS, F.col("video_bitrate") != 0),
        Rule("sample_rate", audio & ~F.col("audio_sample_rate").isin(*SAMPLE_RATES), f"audio_sample_rate is none of {rates}"),
        Rule("hardware_off", (F.col("video_hardware") == "off") & hardware_name, "video_encoder contradicts video_hardware"),
        Rule("path_empty", F.col("output_path") == "", "output_path names no file"),
        Rule("folder_missing", ~F.col("output_folder_exists"), "output_path lies in no folder that exists"),
        Rule(
            "frame_pool",
            F.col("frame_pool") < F.col("queue_video") + SPARE_FRAMES,
            f"frame_pool has to exceed queue_video by {SPARE_FRAMES}",
        ),
    ]


def config_warnings() -> list[Rule]:
    """Accepted, but worth telling early."""
    risky = (
        (F.col("output_format") == "mp4") & (F.col("video_codec") == "av1") & ~F.col("output_fragmented")
    )
    return [Rule("av1_in_plain_mp4", risky, "AV1 in an unfragmented MP4: check the player")]


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``violations``: every broken rule of the row, found in one scan."""
    entries = [
        F.when(rule.broken, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.message).alias("message")))
        for rule in rules
    ]
    return df.withColumn("violations", F.array_compact(F.array(*entries)))


def violation_rows(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return validated.select(*keys, F.explode("violations").alias("v")).select(*keys, "v.rule", "v.message")


def unknown_keys(df: DataFrame, json: str, known: Sequence[str], out: str = "unknown_keys") -> DataFrame:
    """Top-level JSON keys that are not in ``known``."""
    keys = F.array_except(F.json_object_keys(F.col(json)), F.array(*[F.lit(k) for k in known]))
    return df.withColumn(out, keys)


def layered_overrides(base: DataFrame, key: str, layers: Sequence[DataFrame], defaults: Mapping[str, object]) -> DataFrame:
    """Settings of every ``key``: the last layer with a value wins, below all of them the defaults.

    Layers have one row per key and go from weak to strong.
    """
    fields = list(defaults)
    out = base.select(key).distinct()
    for i, layer in enumerate(layers):
        out = out.join(layer.select(key, *[F.col(f).alias(f"_{i}_{f}") for f in fields]), key, "left")
    strongest_first = range(len(layers) - 1, -1, -1)
    return out.select(
        key, *[F.coalesce(*[F.col(f"_{i}_{f}") for i in strongest_first], F.lit(defaults[f])).alias(f) for f in fields]
    )
