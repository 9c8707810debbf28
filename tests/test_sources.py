from __future__ import annotations

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from streamgrid.operators import written
from streamgrid.operators.align import shared_slots
from streamgrid.operators.grid import assign_slots, coalesce_slots
from streamgrid.plans.inputs import events
from streamgrid.sources import observations, sinks


def test_filter_and_columns_reach_the_scan(spark):
    df = events(spark, SMALL, where=F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("us", "value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_mapping_is_checked(spark):
    with pytest.raises(ValueError, match="canonical"):
        events(spark, SMALL).transform(lambda df: observations.to_schema(df, {"nope": F.lit(1)}, df.schema))


def test_event_time_fallback(spark):
    df = spark.createDataFrame([(5, 9), (0, 9), (None, 9), (-1, 9)], "h bigint, a bigint")
    out = observations.choose_event_time(df, "h", "a")
    assert rows(out, "us", "used_fallback") == [(5, False), (9, True), (9, True), (9, True)]


def test_spine(spark):
    assert [r["us"] for r in observations.time_spine(spark, 10, 35, 10).orderBy("k").collect()] == [10, 20, 30]
    jump = spark.range(1).select(
        observations.current_deadline(F.lit(155), F.lit(0), F.lit(2), 10).alias("late"),
        observations.current_deadline(F.lit(29), F.lit(0), F.lit(2), 10).alias("early"),
    )
    assert tuple(jump.first()) == (15, 2)


def test_chunk_reasons(spark):
    df = spark.createDataFrame(
        [("s", "a", 1, 2, [1.0, 2.0]), ("s", "a", 1, 2, [1.0]), ("s", "a", 1, 2, []), (None, "a", 1, 2, [1.0, 2.0])],
        "session_id string, stream_id string, us bigint, channels int, samples array<float>",
    )
    good, rejected = observations.split_malformed(df, observations.chunk_reason())
    assert good.count() == 1
    assert rows(rejected, "reason") == [("empty",), ("incomplete",), ("null_session_id",)]


def test_written_files_are_sorted_and_a_changed_copy_is_noticed(spark, tmp_path):
    df = events(spark, SMALL)
    path = str(tmp_path / "out")
    sinks.write_merged(df, path)
    disorder = (
        spark.read.parquet(path)
        .withColumn("file", F.input_file_name())
        .groupBy("file")
        .agg(F.collect_list("us").alias("u"))
        .filter(F.col("u") != F.array_sort("u"))
    )
    assert disorder.count() == 0
    assert sinks.verify_written(spark, path, df).filter("NOT ok").count() == 0
    assert sinks.verify_written(spark, path, df.filter("seq <> 3")).filter("NOT ok").count() == 1


def test_shared_slots(observe):
    df = observe([("a", 0, 0, 0), ("a", 1, 100, 0), ("b", 2, 95, 0)])
    slots = coalesce_slots(assign_slots(df, 100))
    assert rows(shared_slots(slots, "a", "b"), "slot") == [(1,)]


def _order_of(spark, path, **how):
    found = written.written_order(spark, path, ["us", "seq"], **how).collect()
    return {r["folder"].rpartition("/")[2]: (r["rows"], r["backward"], r["stepped"], r["in_order"]) for r in found}


def test_written_order_is_told_from_footers_and_rows(spark, tmp_path):
    schema = "us bigint, seq bigint"

    def write(folder, parts):
        """One file per part, named in this order."""
        for i, part in enumerate(parts):
            one = tmp_path / f"{folder}-{i}"
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(one))
            (tmp_path / folder).mkdir(exist_ok=True)
            (file,) = one.glob("*.parquet")
            file.rename(tmp_path / folder / f"part-{i:05d}.parquet")
        return str(tmp_path / folder)

    a, b, c = [(1, 1), (2, 2)], [(3, 1), (3, 4), (5, 5)], [(5, 6), (9, 9)]
    assert _order_of(spark, write("good", [a, b, c])) == {"good": (7, 0, 0, True)}
    # Swapped files are seen in the footers alone.
    swapped = write("swapped", [a, c, b])
    assert _order_of(spark, swapped) == {"swapped": (7, 1, 1, False)}
    assert _order_of(spark, swapped, read_rows=False) == {"swapped": (7, 1, None, False)}
    # Files that touch, and rows inside a file, need the rows.
    assert _order_of(spark, write("touch", [a, b, [(5, 2), (9, 9)]])) == {"touch": (7, 0, 1, False)}
    inside = write("inside", [a, [(3, 4), (3, 1), (5, 5)], c])
    assert _order_of(spark, inside) == {"inside": (7, 0, 1, False)}
    assert _order_of(spark, inside, read_rows=False) == {"inside": (7, 0, None, True)}
    assert _order_of(spark, write("nulls", [[(None, None), (1, 1)], [(2, None)]])) == {"nulls": (3, 0, 0, True)}


def test_row_groups_of_one_file_are_audited(spark, tmp_path):
    rows_ = spark.range(0, 60_000, 1, 1).selectExpr("id AS us", "id AS seq")
    rows_.write.option("parquet.block.size", 65_536).option("parquet.page.size", 8_192).parquet(str(tmp_path / "many"))
    extents = written.file_extents(spark, str(tmp_path / "many"))
    assert extents.count() > 1 and extents.agg(F.sum("rows")).first()[0] == 60_000
    assert _order_of(spark, str(tmp_path / "many")) == {"many": (60_000, 0, 0, True)}
