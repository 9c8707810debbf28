"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgrid.session import apply_settings, ensure_checkpoint_dir

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Bytes of texts that go to a Python worker at once; a task holds a few times that, whatever the texts' lengths.
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches bounded by the bytes of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return apply_settings(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files, so that a lost executor repeats nothing before."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_struct(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """Add the fields of ``struct`` as columns; a column of the same name is replaced. ``struct`` is evaluated once."""
    held = free_name([*df.columns, *fields], "_held")
    gone = {f.lower() for f in fields}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
    return df.withColumn(held, struct).select(*kept, *[F.col(held)[f].alias(f) for f in fields])


def struct_column(fn: Callable[[str], tuple], schema: pa.StructType, col: Column) -> Column:
    """``fn`` of each text (null: empty) as a struct column, one Arrow batch at a time."""
    names = [schema.field(i).name for i in range(schema.num_fields)]
    ddl = "struct<" + ",".join(f"{f.name}:{_DDL[f.type]}" for f in schema) + ">"

    @F.arrow_udf(ddl)
    def run(texts: pa.Array) -> pa.Array:
        rows = [fn(t.as_py() or "") for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        arrays = [pa.array(c, schema.field(i).type) for i, c in enumerate(columns)]
        return pa.StructArray.from_arrays(arrays, names)

    return run(col)


_DDL = {
    pa.int64(): "bigint",
    pa.int32(): "int",
    pa.float64(): "double",
    pa.string(): "string",
    pa.binary(): "binary",
    pa.bool_(): "boolean",
    pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.int32()): "array<int>",
    pa.list_(pa.float64()): "array<double>",
}
