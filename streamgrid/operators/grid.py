"""Constant-rate grid: slotting, late re-slotting, coalescing, gap filling and the variable-rate form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamgrid.functions.scalars import ceil_div, floor_div, slot_of
from streamgrid.operators.joins import lookup_join
from streamgrid.operators.ordered import lead, ordered, refuse_null, row_number, running_max
from streamgrid.schema import STREAM_KEYS

# Slots are unique per stream after coalescing, so a part holds at most this many rows.
PART_SLOTS = 65_536
# A long gap is expanded block by block, so no array grows with the gap.
FILL_BLOCK = 16_384
# Spark's default spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000


def assign_slots(df: DataFrame, period_us: int, anchor: str = "origin") -> DataFrame:
    """Nearest slot of every row (needs ``t0``).

    ``anchor="origin"`` puts slot 0 at ``t0``, so slots of different streams are comparable;
    ``anchor="first"`` puts slot 0 of each stream at its first kept row.
    """
    if anchor == "origin":
        df = df.withColumn("anchor_us", F.col("t0"))
    elif anchor == "first":
        firsts = df.groupBy(*STREAM_KEYS).agg(F.min("us").alias("anchor_us"))
        df = lookup_join(df, firsts, STREAM_KEYS, spread_by=["seq"])
    else:
        raise ValueError("anchor must be 'origin' or 'first'")
    return df.withColumn("slot", slot_of("us", F.col("anchor_us"), period_us))


def reslot_late(df: DataFrame, period_us: int, lookahead_us: int) -> DataFrame:
    """Move rows that arrive after their slot has left to the next open slot; nothing is dropped."""
    open_slot = ceil_div(F.col("arrival_us") - F.col("anchor_us") - F.lit(lookahead_us), period_us)
    return (
        df.withColumn("nominal_slot", F.col("slot"))
        .withColumn("slot", F.greatest("nominal_slot", open_slot))
        .withColumn("late", F.col("slot") > F.col("nominal_slot"))
    )


def coalesce_slots(df: DataFrame, by_arrival: bool = False) -> DataFrame:
    """Last row wins per (stream, slot); the others are counted as superseded.

    One aggregate with map-side combine: a slot or stream that holds a third of all rows is reduced before
    the shuffle. Order key (us, seq), or (arrival, us, seq) when re-slotted rows compete. The key of two is packed
    into one number, so that rows are combined by hash; the key of three is a struct, for which Spark sorts.
    """
    late = F.count_if(F.col("late")) if "late" in df.columns else F.lit(0).cast("bigint")
    counts = ((F.count(F.lit(1)) - 1).alias("superseded"), late.alias("late"))
    if not by_arrival:
        packed = df.withColumn("_rank", packed_rank("us", "seq"))
        return packed.groupBy(*STREAM_KEYS, "slot").agg(
            F.max("us").alias("us"), F.max_by("seq", "_rank").alias("seq"), F.max_by("value", "_rank").alias("value"), *counts
        )
    last = F.max(F.struct("arrival_us", "us", "seq", "value")).alias("_last")
    return (
        df.groupBy(*STREAM_KEYS, "slot")
        .agg(last, *counts)
        .select(*STREAM_KEYS, "slot", "_last.us", "_last.seq", "_last.value", "superseded", "late")
    )


def packed_rank(us: str, seq: str) -> Column:
    """(us, seq) as one number of the same order, a null ``seq`` first. Times have to lie within 62 bits."""
    whole = lambda c: F.lit(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    low = F.coalesce(F.col(seq).cast("bigint"), F.lit(-(2**63)))
    return whole(F.col(us)) * whole(str(2**64)) + whole(low)


def fill_gaps(
    slots: DataFrame,
    max_fill: int | None = None,
    end_slot: Column | int | None = None,
    slot_bound: int | None = None,
    part_slots: int = PART_SLOTS,
    fill_block: int = FILL_BLOCK,
) -> DataFrame:
    """Repeat the previous row in empty slots; a run longer than ``max_fill`` becomes one ``skipped`` row.

    Nothing is emitted before the first row of a stream. ``end_slot`` continues the grid after the last row.
    Filled rows copy the value of the row they repeat; it is computed once per fresh slot. ``slot_bound`` is a
    known bound of the slots per stream; a small one spares the cut into slot ranges.
    """
    part = floor_div("slot", part_slots)
    rows = ordered(slots, STREAM_KEYS, ["slot"], part=part, rows_bound=slot_bound).scan(_next=lead("slot")).result()
    if end_slot is not None:
        end = end_slot if isinstance(end_slot, Column) else F.lit(end_slot)
        rows = rows.withColumn("_next", F.coalesce("_next", end.cast("bigint") + 1))
    zero, slot, last = F.lit(0).cast("bigint"), F.col("slot"), F.coalesce(F.col("_next") - 1, F.col("slot"))
    run = F.greatest(last - slot, zero)
    skipped = F.lit(False) if max_fill is None else run > max_fill
    # A fresh slot and the slots that repeat it are one run [slot, last]; a skipped run keeps its first slot only.
    rows = rows.withColumns({"_skipped": skipped, "_last": F.greatest(last, slot)})
    first, stop = F.col("slot"), F.col("_last")
    if max_fill is None or max_fill >= fill_block:
        starts = F.sequence("slot", "_last", F.lit(fill_block).cast("bigint"))
        rows = rows.withColumn("_start", F.explode(F.when(F.col("_skipped"), F.array("slot")).otherwise(starts)))
        first, stop = F.col("_start"), F.least(F.col("_last"), F.col("_start") + (fill_block - 1))
    slots_of_run = F.when(F.col("_skipped"), F.array(F.col("slot"), F.col("slot") + 1)).otherwise(F.sequence(first, stop))
    out = rows.withColumn("_slot", F.explode(slots_of_run))
    fresh = F.col("_slot") == F.col("slot")
    skip = F.col("_skipped") & ~fresh
    return out.select(
        *STREAM_KEYS,
        F.col("_slot").alias("slot"),
        F.when(skip, F.col("_last")).otherwise(F.col("_slot")).alias("slot_to"),
        F.when(fresh, "fresh").when(skip, "skipped").otherwise("filled").alias("status"),
        F.when(~skip, F.col("us")).alias("us"),
        F.when(~skip, F.col("seq")).alias("seq"),
        F.when(~skip, F.col("value")).alias("value"),
        F.when(fresh, F.col("superseded")).otherwise(zero).alias("superseded"),
        F.when(fresh, F.col("late")).otherwise(zero).alias("late"),
        F.when(skip, F.col("_last") - F.col("_slot") + 1).otherwise(zero).alias("lost"),
    )


def status_counts(filled: DataFrame) -> DataFrame:
    """Slot audit per stream. ``slots`` counts grid slots, so a skipped run counts all of its slots."""
    return filled.groupBy(*STREAM_KEYS).agg(
        F.count_if(F.col("status") == "fresh").alias("fresh"),
        F.count_if(F.col("status") == "filled").alias("filled"),
        F.sum("lost").alias("skipped"),
        F.sum("superseded").alias("superseded"),
        F.sum("late").alias("late"),
        F.count_if(F.col("status") == "skipped").alias("overloads"),
        F.sum(F.col("slot_to") - F.col("slot") + 1).alias("slots"),
    )


def monotonic_thin(df: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Variable rate: keep real times relative to ``t0``, drop rows not strictly later than all kept before.

    The last kept tick equals the running maximum of all earlier ticks, so no recurrence is needed.
    """
    rows = ordered(
        df.withColumn("tick", F.col("us") - F.col("t0")), STREAM_KEYS, ["arrival_us", "seq"], hot_rows=hot_rows
    )
    rows = rows.scan(_latest=running_max("tick", inclusive=False)).result()
    return rows.filter(F.col("_latest").isNull() | (F.col("tick") > F.col("_latest"))).drop("_latest")


def cap_rows(df: DataFrame, limit: int, hot_rows: int | None = None) -> DataFrame:
    """The first ``limit`` rows of every stream in event order.

    Small limits are cut in every map task before the shuffle (window group limit), which also holds for a hot
    stream; larger ones are ranked by an ordered scan.
    """
    if limit <= GROUP_LIMIT:
        window = W.partitionBy(*STREAM_KEYS).orderBy("us", "seq")
        df = df.withColumns(refuse_null(STREAM_KEYS))
        return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")
    rows = ordered(df, STREAM_KEYS, ["us", "seq"], hot_rows=hot_rows).scan(_rank=row_number()).result()
    return rows.filter(F.col("_rank") <= limit).drop("_rank")


def cap_duration(df: DataFrame, duration_us: int) -> DataFrame:
    """Rows before ``t0 + duration`` (needs ``t0``)."""
    return df.filter(F.col("us") < F.col("t0") + F.lit(duration_us))
