"""Bitrate planning, ranked candidates and the first success by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.functions.lookups import ENCODERS, classify_by_suffix, constant_table
from streamgrid.functions.scalars import force_even

# Quality, bits per pixel and second, constant quantiser.
QUALITIES = [("low", 0.035, 32), ("medium", 0.07, 27), ("high", 0.12, 23), ("very_high", 0.20, 19)]
# Codec, bitrate factor.
CODEC_FACTORS = [("h264", 1.0), ("hevc", 0.7), ("av1", 0.6)]
# Bounds of a planned bitrate, smallest picture side, share of the VBR cap.
BITRATE_MIN = 1_000_000
BITRATE_MAX = 200_000_000
SIDE_MIN = 16
VBR_CAP = 1.5

# Vendor, hardware interfaces in order of preference.
VENDOR_INTERFACES = {
    "intel": ("vaapi", "qsv"),
    "amd": ("vaapi", "amf"),
    "nvidia": ("nvenc", "vaapi"),
    "other": ("vaapi", "qsv", "nvenc", "amf"),
}
# Codec, software encoders from fast to slow.
SOFTWARE = {"h264": ("libx264",), "hevc": ("libx265",), "av1": ("libsvtav1", "librav1e", "libaom-av1")}
CODECS = ("h264", "hevc", "av1")
POLICIES = ("auto", "force", "off")


def plan_bitrate(sessions: DataFrame) -> DataFrame:
    """Sizes, bitrate, cap and quantiser of a session.

    Needs width, height, fps, codec, quality, bitrate and rate_control. An explicit bitrate wins. Both
    dimensions have a constant size and are broadcast. The quantiser is set for ``cq``, the cap otherwise.
    """
    spark = sessions.sparkSession
    quality = constant_table(spark, ["quality", "_bpp", "_cq"], QUALITIES)
    factor = constant_table(spark, ["codec", "_factor"], CODEC_FACTORS)
    rows = sessions.join(F.broadcast(quality), "quality", "left").join(F.broadcast(factor), "codec", "left")
    pixels = F.col("width").cast("double") * F.col("height").cast("double")
    planned = (pixels * F.col("fps").cast("double") * F.col("_bpp") * F.col("_factor")).cast("bigint")
    bounded = F.least(F.greatest(planned, F.lit(BITRATE_MIN).cast("bigint")), F.lit(BITRATE_MAX).cast("bigint"))
    rows = rows.withColumn("planned_bitrate", F.when(F.col("bitrate") > 0, F.col("bitrate")).otherwise(bounded))
    cap = (
        F.when(F.col("rate_control") == "vbr", (F.col("planned_bitrate") * VBR_CAP).cast("bigint"))
        .when(F.col("rate_control") == "cbr", F.col("planned_bitrate"))
    )
    return (
        rows.withColumn("max_bitrate", cap)
        .withColumn("quantiser", F.when(F.col("rate_control") == "cq", F.col("_cq")))
        .withColumn("even_width", force_even("width"))
        .withColumn("even_height", force_even("height"))
        .withColumn("size_ok", (F.col("even_width") >= SIDE_MIN) & (F.col("even_height") >= SIDE_MIN))
        .drop("_bpp", "_cq", "_factor")
    )


def preference_table(spark: SparkSession) -> DataFrame:
    """(codec, vendor, policy) to the ordered candidates, built from the preference rule; constant size."""
    accel = {name: cls for name, _, cls in ENCODERS}
    codec_of = {name: codec for name, codec, _ in ENCODERS}
    rows = []
    for codec in CODECS:
        for vendor, interfaces in VENDOR_INTERFACES.items():
            hardware = [f"{c}_{i}" for c in (codec, *CODECS) for i in interfaces]
            software = [*SOFTWARE[codec], *SOFTWARE["h264"]]
            for policy in POLICIES:
                names = (hardware if policy != "off" else []) + (software if policy != "force" else [])
                for rank, name in enumerate(dict.fromkeys(names), start=1):
                    rows.append((codec, vendor, policy, rank, name, codec_of[name], accel[name]))
    columns = ["codec", "vendor", "policy", "rank", "name", "candidate_codec", "class"]
    return constant_table(spark, columns, rows)


def rank_candidates(requests: DataFrame) -> DataFrame:
    """Candidates of every request in the order to try them.

    Needs request_id, codec, vendor, policy and forced_name; a forced name is the only candidate. No shuffle:
    ranks are part of the broadcast preference table.
    """
    spark = requests.sparkSession
    free = F.coalesce(F.col("forced_name"), F.lit("")) == ""
    ranked = (
        requests.filter(free)
        .join(F.broadcast(preference_table(spark)), ["codec", "vendor", "policy"])
        .select("request_id", "rank", "name", "candidate_codec", "class")
    )
    known = constant_table(spark, ["forced_name", "_codec"], [(name, codec) for name, codec, _ in ENCODERS])
    forced = classify_by_suffix(requests.filter(~free), "forced_name").join(F.broadcast(known), "forced_name", "left")
    forced = forced.select(
        "request_id",
        F.lit(1).alias("rank"),
        F.when(F.col("_codec").isNotNull(), F.col("forced_name")).otherwise("?").alias("name"),
        F.coalesce("_codec", "codec").alias("candidate_codec"),
        "class",
    )
    return ranked.unionByName(forced)


def first_success(attempts: DataFrame) -> DataFrame:
    """First attempt by rank that worked, with the failures before it in order.

    Needs request_id, rank, name, codec (asked for), candidate_codec, ok and err. ``fallback`` tells that the codec
    opened is not the one asked for. Without a success ``name`` and it are null and all failures are listed.
    Attempts of one request are bounded by the preference table.
    """
    best = F.min(F.when(F.col("ok"), F.struct("rank", "name", "codec", "candidate_codec")))
    failures = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("rank", "name", "err"))))
    rows = attempts.groupBy("request_id").agg(best.alias("_best"), failures.alias("_failures"))
    before = F.filter("_failures", lambda f: F.col("_best").isNull() | (f["rank"] < F.col("_best.rank")))
    return rows.select(
        "request_id",
        F.col("_best.rank").alias("rank"),
        F.col("_best.name").alias("name"),
        F.col("_best").isNotNull().alias("opened"),
        (F.col("_best.candidate_codec") != F.col("_best.codec")).alias("fallback"),
        F.transform(before, lambda f: F.format_string("%s (%s)", f["name"], f["err"])).alias("failures"),
    )
