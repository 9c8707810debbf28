"""The regularisation plan: origin, trim, slots, late rows, coalescing, gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from streamgrid.operators import grid
from streamgrid.operators.joins import bounded
from streamgrid.operators.origin import attach_origin, common_origin, session_bounds, trim_pre_origin


def anchored(observations: DataFrame, timeout_us: int | None = None) -> DataFrame:
    """Rows at or after their session's common origin, with ``t0``."""
    return trim_pre_origin(attach_origin(observations, common_origin(observations, timeout_us=timeout_us)))


def slotted_with_bound(
    observations: DataFrame, period_us: int, lookahead_us: int | None = None, anchor: str = "origin"
) -> tuple[DataFrame, int | None]:
    """One row per (stream, slot), and a bound of the slots per stream where the sessions are few enough.

    With a lookahead, late rows move to the next open slot first, so the last arrival bounds the slots as well.
    """
    bounds = bounded(session_bounds(observations, by_arrival=lookahead_us is not None))
    with_origin = attach_origin(observations, bounds).drop("end_us", "end_arrival_us")
    rows = grid.assign_slots(trim_pre_origin(with_origin), period_us, anchor)
    limit = None
    if bounds.is_local:
        # A session has an origin exactly if it has a time.
        columns = {c: [v or 0 for v in bounds.table[c].to_pylist()] for c in bounds.table.column_names if c != "session_id"}
        ends = columns["end_us"]
        if lookahead_us is not None:
            ends = [max(e, a - lookahead_us) for e, a in zip(ends, columns["end_arrival_us"], strict=True)]
        limit = max((max(0, e - t0) // period_us + 2 for e, t0 in zip(ends, columns["t0"], strict=True)), default=0)
    if lookahead_us is not None:
        return grid.coalesce_slots(grid.reslot_late(rows, period_us, lookahead_us), by_arrival=True), limit
    return grid.coalesce_slots(rows), limit


def slotted(
    observations: DataFrame, period_us: int, lookahead_us: int | None = None, anchor: str = "origin"
) -> DataFrame:
    """One row per (stream, slot)."""
    return slotted_with_bound(observations, period_us, lookahead_us, anchor)[0]


def regularise(
    observations: DataFrame,
    period_us: int,
    max_fill: int | None = None,
    lookahead_us: int | None = None,
    anchor: str = "origin",
) -> DataFrame:
    """Irregular observations to a constant-rate grid per stream."""
    slots, limit = slotted_with_bound(observations, period_us, lookahead_us, anchor)
    return grid.fill_gaps(slots, max_fill, slot_bound=limit)
