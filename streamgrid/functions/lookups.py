"""Lookups against fixed dimensions. The dimensions have a constant size, so broadcasting them is always safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encoder name, codec, acceleration.
ENCODERS = [
    ("h264_vaapi", "h264", "hw_frames"),
    ("hevc_vaapi", "hevc", "hw_frames"),
    ("av1_vaapi", "av1", "hw_frames"),
    ("h264_qsv", "h264", "hw_frames"),
    ("hevc_qsv", "hevc", "hw_frames"),
    ("av1_qsv", "av1", "hw_frames"),
    ("h264_nvenc", "h264", "hw_direct"),
    ("hevc_nvenc", "hevc", "hw_direct"),
    ("av1_nvenc", "av1", "hw_direct"),
    ("h264_amf", "h264", "hw_direct"),
    ("hevc_amf", "hevc", "hw_direct"),
    ("av1_amf", "av1", "hw_direct"),
    ("libx264", "h264", "software"),
    ("libx265", "hevc", "software"),
    ("libsvtav1", "av1", "software"),
    ("librav1e", "av1", "software"),
    ("libaom-av1", "av1", "software"),
]
# Name suffix, acceleration.
SUFFIX_RULES = [
    ("_vaapi", "hw_frames"),
    ("_qsv", "hw_frames"),
    ("_nvenc", "hw_direct"),
    ("_amf", "hw_direct"),
    ("_mf", "hw_direct"),
]
DEFAULT_CLASS = "software"

# PCI vendor id, vendor.
VENDORS = [(0x8086, "intel"), (0x1002, "amd"), (0x1022, "amd"), (0x10DE, "nvidia")]
DEFAULT_VENDOR = "other"

# Accepted spelling, canonical name.
CODEC_ALIASES = [("h265", "hevc"), ("h.265", "hevc")]
QUALITY_ALIASES = [("veryhigh", "very_high")]


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A literal table (``VALUES``), planned as a local relation."""
    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"{value!r}D"
        return str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def classify_by_suffix(df: DataFrame, name: str, out: str = "class") -> DataFrame:
    """Exact name first, then suffix rules, else the default."""
    dim = constant_table(df.sparkSession, ["_name", "_codec", "_class"], ENCODERS).select("_name", "_class")
    by_suffix = F.lit(None).cast("string")
    for suffix, label in reversed(SUFFIX_RULES):
        by_suffix = F.when(F.col(name).endswith(suffix), F.lit(label)).otherwise(by_suffix)
    return (
        df.join(F.broadcast(dim), F.col(name) == F.col("_name"), "left")
        .withColumn(out, F.coalesce("_class", by_suffix, F.lit(DEFAULT_CLASS)))
        .drop("_name", "_class")
    )


def code_label(df: DataFrame, code: str, out: str = "vendor") -> DataFrame:
    """Vendor of a numeric id, unknown ids give the default."""
    dim = constant_table(df.sparkSession, ["_code", "_label"], VENDORS)
    return (
        df.join(F.broadcast(dim), F.col(code) == F.col("_code"), "left")
        .withColumn(out, F.coalesce("_label", F.lit(DEFAULT_VENDOR)))
        .drop("_code", "_label")
    )


def normalise_alias(df: DataFrame, name: Column | str, aliases: list[tuple[str, str]], out: str) -> DataFrame:
    """Canonical spelling of an enum value."""
    name = F.col(name) if isinstance(name, str) else name
    dim = constant_table(df.sparkSession, ["_alias", "_canonical"], aliases)
    return (
        df.withColumn("_spelling", F.lower(name))
        .join(F.broadcast(dim), F.col("_spelling") == F.col("_alias"), "left")
        .withColumn(out, F.coalesce("_canonical", "_spelling"))
        .drop("_spelling", "_alias", "_canonical")
    )
