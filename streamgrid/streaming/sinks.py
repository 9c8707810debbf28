"""Running a stream to completion, segment files, the status table and rate reports."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from streamgrid.sources.sinks import scratch_path


def write_available(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Process what is there, write files exactly once, flush and stop. A restart continues from the checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def drain(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Run a stream over the available input into a fresh folder and read the result back."""
    path = scratch_path(spark, name)
    schema = df.schema
    write_available(df, path + "/data", path + "/checkpoint", partition_by)
    return spark.read.schema(schema).parquet(path + "/data")


def status_writer(path: str, by: Sequence[str] = ("session_id",)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: one status row per group and micro-batch.

    A replayed batch overwrites its own folder, so counters are not doubled after a failure.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        status = batch.groupBy(*by).agg(
            F.count(F.lit(1)).alias("rows"), F.min("us").alias("from_us"), F.max("us").alias("to_us")
        )
        status.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def write_status(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("session_id",)) -> StreamingQuery:
    query = (
        df.writeStream.foreachBatch(status_writer(path, by))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


class RateListener(StreamingQueryListener):
    """Keeps the latest input and processing rates, and running totals of rows read and dropped as too late."""

    def __init__(self, keep: int = 1000):
        self.reports: deque[dict] = deque(maxlen=keep)
        self.rows = self.dropped_late = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.rows += p.numInputRows
        self.dropped_late += late
        self.reports.append({
            "batch": p.batchId,
            "rows": p.numInputRows,
            "input_per_sec": p.inputRowsPerSecond,
            "processed_per_sec": p.processedRowsPerSecond,
            "dropped_late": late,
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
