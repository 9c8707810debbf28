"""Audit of merged output as it lies in its files: ranges from footers, order of rows from a narrow scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.operators.ordered import ordered, running_max

EXTENTS = "folder string, file string, row_group bigint, rows bigint, low bigint, high bigint, nulls bigint"


def _open(uri: str) -> tuple[pfs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    return pfs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri)


def _row_groups(uri: str, column: str) -> Iterator[tuple]:
    system, where = _open(uri)
    with system.open_input_file(where) as f:
        meta = pq.ParquetFile(f).metadata
    folder, _, name = where.rpartition("/")
    for i in range(meta.num_row_groups):
        group = meta.row_group(i)
        places = [j for j in range(group.num_columns) if group.column(j).path_in_schema == column]
        stats = group.column(places[0]).statistics if places else None
        low, high = (int(stats.min), int(stats.max)) if stats is not None and stats.has_min_max else (None, None)
        nulls = stats.null_count if stats is not None and stats.has_null_count else None
        yield folder, name, i, group.num_rows, low, high, nulls


def file_extents(spark: SparkSession, path: str, column: str = "us") -> DataFrame:
    """Rows and range of a whole-number ``column`` in every row group below ``path``, from the Parquet footers.

    Spark lists the files and deals them to tasks; a task reads footers only, a few kB a file. The file system has
    to be one that Arrow can open (local, hdfs, s3, gs). Statistics that a writer left out are null.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    names = [c.split()[0] for c in EXTENTS.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int64()] * 5]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [g for uri in batch.column("path").to_pylist() for g in _row_groups(uri, column)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return listed.load(path).select("path").mapInArrow(read, EXTENTS)


def _runs(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """Stretches of a file as the scan's tasks read them: first and last key, rows, and steps back inside."""
    keys = list(order)
    where = F.regexp_replace("_metadata.file_path", "^[a-zA-Z0-9]+:/+", "/")
    rows = spark.read.parquet(path).select(
        F.regexp_replace(where, "/[^/]*$", "").alias("folder"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("place"), *keys,
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}
    schema = "folder string, file string, place bigint, stepped bigint, " + ", ".join(
        f"{end}{i} {kinds[c]}" for end in ("first", "last") for i, c in enumerate(keys)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, types, out = None, None, []
        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            columns = [batch.column(c).to_pylist() for c in ("folder", "file", "place", *keys)]
            for folder, file, place, *key in zip(*columns, strict=True):
                rank = [(k is not None, k) for k in key]
                if run is None or run[:2] != [folder, file] or place != run[4] + 1:
                    if run is not None:
                        out.append(run)
                    run = [folder, file, place, 0, place, key, key, rank]
                    continue
                run[3] += rank < run[7]
                run[4], run[6], run[7] = place, key, rank
        if run is not None:
            out.append(run)
            columns = [[r[i] for r in out] for i in range(4)] + [[r[e][i] for r in out] for e in (5, 6) for i in range(len(keys))]
            kinds_ = [pa.string(), pa.string(), pa.int64(), pa.int64(), *types, *types]
            names = ["folder", "file", "place", "stepped", *[f"{e}{i}" for e in ("first", "last") for i in range(len(keys))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names)

    found = rows.mapInArrow(read, schema)
    ends = {f"_{e}": F.struct(*[f"{e}{i}" for i in range(len(keys))]) for e in ("first", "last")}
    # Both ends as structs with the same field names, so that they can be compared.
    named = {k: F.struct(*[c[f"{k[1:]}{i}"].alias(f"k{i}") for i in range(len(keys))]) for k, c in ends.items()}
    return found.select("folder", "file", "place", "stepped", *[c.alias(k) for k, c in named.items()])


def written_order(
    spark: SparkSession, path: str, order: Sequence[str] = ("us", "stream_id", "seq"), read_rows: bool = True
) -> DataFrame:
    """Is what was written below ``path`` in order? One row per folder; files go by name.

    The footers tell ``backward``, the row groups that begin before the end of what precedes them by the first column
    of ``order``, and ``touching``, those that begin where it ends. With ``read_rows`` the columns of ``order`` are
    read as well, each file as it lies: ``stepped`` counts rows before their predecessor by the whole order, also where
    files and row groups meet. Without, it is null, and order is told by the footers alone.
    """
    extents = file_extents(spark, path, order[0])
    groups = ordered(extents, ["folder"], ["file", "row_group"]).scan(_before=running_max("high", inclusive=False)).result()
    out = groups.groupBy("folder").agg(
        F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("row_groups"), F.sum("rows").alias("rows"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.count_if(F.col("low") < F.col("_before")).alias("backward"),
        F.count_if(F.col("low") == F.col("_before")).alias("touching"),
    )
    if not read_rows:
        return out.withColumns({"stepped": F.lit(None).cast("bigint"), "in_order": F.col("backward") == 0})
    runs = ordered(_runs(spark, path, order), ["folder"], ["file", "place"])
    runs = runs.scan(_earlier=running_max("_last", inclusive=False)).result()
    back = F.coalesce(F.col("_first") < F.col("_earlier"), F.lit(False)).cast("bigint")
    steps = runs.groupBy("folder").agg(F.sum(F.col("stepped") + back).alias("stepped"))
    out = out.join(steps, "folder", "left").withColumn("stepped", F.coalesce("stepped", F.lit(0).cast("bigint")))
    return out.withColumn("in_order", F.col("backward") + F.col("stepped") == 0)
