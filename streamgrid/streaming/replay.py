"""Replaying a table as a stream of files in a given order, closed by an end mark."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.sources.sinks import scratch_path

#: Micro-batches of a replay at least, files in each, and rows in one of them at most (about).
PARTS = 4
FILES_PER_TRIGGER = 2
ROWS_PER_FILE = 2_500_000
#: Rows without a time have no place in the order; they are written beside the others.
TIMED, UNTIMED = "_timed=true", "_timed=false"


class Replay(NamedTuple):
    """Folders of the rows in order and of the rows without a time, and the files that make a micro-batch."""

    path: str
    untimed: str
    files_per_trigger: int


def write_replay(
    df: DataFrame, order: Column, end: Mapping[str, Column] | None = None, parts: int = PARTS,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> Replay:
    """Write ``df`` as files whose ranges of the whole number ``order`` follow each other.

    One job deals the rows to ranges of about equal size (Spark samples their bounds; a hash of the row parts equal
    times), one file each, whatever the spread of the times. A file stream reads by modification time, so the files
    are then dated by their range: only metadata, a call per file. Rows whose ``order`` is null go to ``untimed``.

    ``end`` gives the columns of one last row, the end mark, as functions of ``_last``, the largest ``order``. Its
    time has to lie so far behind the data that the watermark passes everything open; the others are null.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "replay")
    last, rows = df.agg(F.max(order), F.count(F.lit(1))).first()
    files = max(parts, math.ceil(rows / ROWS_PER_FILE / files_per_trigger)) * files_per_trigger
    dealt = df.withColumns({"_order": order, "_timed": order.isNotNull()}).repartitionByRange(
        files, "_timed", "_order", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    )
    dealt.drop("_order").write.partitionBy("_timed").parquet(path)
    timed = f"{path}/{TIMED}"
    _date_by_name(spark, timed)
    if end is not None and last is not None:
        mark = spark.range(0, 1, 1, 1).withColumn("_last", F.lit(last).cast("bigint"))
        columns = [end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]
        mark.select(*columns).write.mode("append").parquet(timed)
    elif last is None:
        df.limit(0).write.mode("append").parquet(timed)
    return Replay(timed, f"{path}/{UNTIMED}", files_per_trigger)


def _date_by_name(spark: SparkSession, folder: str) -> None:
    """Give the files of a folder modification times, a millisecond apart, in the order of their names (their ranges)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return
    found = sorted(
        ((s.getPath(), s.getModificationTime()) for s in system.listStatus(path) if s.getPath().getName().startswith("part-")),
        key=lambda s: s[0].getName(),
    )
    first = min((t for _, t in found), default=0) - len(found)
    for i, (file, _) in enumerate(found):
        system.setTimes(file, first + i, -1)


def untimed_rows(spark: SparkSession, replay: Replay, schema: str) -> DataFrame:
    """The rows that had no time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(replay.untimed)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(replay.untimed)
