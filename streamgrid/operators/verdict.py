"""Verdict, diagnosis and fault rows of a session's counter board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The strict verdict asks for 99 % of the target and no loss, the summary for 97 %.
SUSTAINED_SHARE = 0.99
SUMMARY_SHARE = 0.97
SOURCE_SHARE = 0.95

# Counters that should be zero.
FAULT_COUNTERS = (
    "lost", "gaps_filled", "dropped_units", "intake_overrun", "encoder_overload", "audio_overrun", "disk_write_lag",
)


def verdict(board: DataFrame, rate: str = "emitted_per_sec", target: str = "target") -> DataFrame:
    """``sustained``: 99 % of the target rate and nothing lost. ``summary_met``: 97 % of the target rate."""
    return board.withColumn(
        "sustained", (F.col(rate) >= F.col(target) * SUSTAINED_SHARE) & (F.col("lost") == 0)
    ).withColumn("summary_met", F.col(rate) >= F.col(target) * SUMMARY_SHARE)


def _rule(condition: Column, cause: str) -> Column:
    return F.when(condition, F.lit(cause))


def diagnosis(board: DataFrame) -> DataFrame:
    """Ordered causes of a missed target; ``source_limited_default`` when no rule fires."""
    overloaded = (F.col("encoder_overload") > 0) | (F.col("skipped") > 0)
    causes = F.array_compact(
        F.array(
            _rule(overloaded, "encoder_bottleneck"),
            _rule(overloaded & ~F.col("hardware"), "software_encoder"),
            _rule(overloaded & F.col("hardware"), "lower_quality"),
            _rule(F.col("intake_overrun") > 0, "intake_queue_overflow"),
            _rule(F.col("disk_write_lag") > 0, "disk_lag"),
            _rule(
                (F.col("received_per_sec") < F.col("target") * SOURCE_SHARE) & (F.col("lost") == 0), "source_too_slow"
            ),
        )
    )
    default = F.array(F.lit("source_limited_default"))
    return board.withColumn("causes", F.when(F.size(causes) == 0, default).otherwise(causes))


def diagnosis_rows(diagnosed: DataFrame, key: str = "session_id") -> DataFrame:
    return diagnosed.select(key, F.posexplode("causes").alias("position", "cause"))


def fault_rows(board: DataFrame, keys: Sequence[str], counters: Sequence[str] = FAULT_COUNTERS) -> DataFrame:
    """Counters that should be zero and are not, one row each."""
    wide = board.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in counters])
    return wide.unpivot(list(keys), list(counters), "counter", "value").filter(F.col("value") > 0)
