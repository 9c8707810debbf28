"""Counted clock against wall clock: position, drift, correction plan, applied correction, relative drift."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamgrid.functions.scalars import US_PER_SEC, int_div
from streamgrid.operators.align import asof_scan
from streamgrid.operators.ordered import PART, first_value, lag, ordered, running_sum
from streamgrid.schema import STREAM_KEYS

# Deadband 1/1000, largest step 1/100 of the rate, an eighth of the drift per correction.
DEADBAND_DIVISOR = 1000
STEP_DIVISOR = 100
SMOOTHING = 8


def units_in(elapsed_us: Column, rate: int, tb_us: int = US_PER_SEC) -> Column:
    """``elapsed * rate / tb`` truncated toward zero, without overflowing for long spans."""
    tb = F.lit(tb_us).cast("bigint")
    whole = int_div(elapsed_us, tb)
    rest = elapsed_us - whole * tb
    return whole * F.lit(rate).cast("bigint") + int_div(rest * F.lit(rate).cast("bigint"), tb)


def us_of_units(units: Column, rate: int, tb_us: int = US_PER_SEC) -> Column:
    return units_in(units, tb_us, rate)


def counted_pts(
    df: DataFrame, units: str = "units", hot_rows: int | None = None, rows_bound: int | None = None
) -> DataFrame:
    """Units emitted before each block: an exact timestamp without jitter."""
    rows = ordered(df, STREAM_KEYS, ["us", "seq"], hot_rows=hot_rows, rows_bound=rows_bound)
    return rows.scan(counted=running_sum(F.col(units).cast("bigint"), inclusive=False)).result()


def drift(df: DataFrame, rate: int, anchor: str = "anchor_us", tb_us: int = US_PER_SEC) -> DataFrame:
    """Expected minus counted units; positive means the counted clock lags."""
    expected = units_in(F.col("us") - F.col(anchor), rate, tb_us)
    return (
        df.withColumn("expected", expected)
        .withColumn("drift", F.col("expected") - F.col("counted"))
        .withColumn("drift_us", us_of_units(F.col("drift"), rate, tb_us))
        .withColumn("media_us", F.col(anchor) + us_of_units(F.col("counted"), rate, tb_us))
    )


def max_gap_units(rate: int, max_gap_ms: int) -> int:
    return rate * max_gap_ms // 1000


def plan_correction(df: DataFrame, rate: int, max_gap: int, enabled: bool = True, of: str = "drift") -> DataFrame:
    """``action`` (none, compensate, insert, drop) and ``amount`` for a drift; a pure function of the drift."""
    d = F.col(of).cast("bigint")
    step = rate // STEP_DIVISOR
    soft = F.least(F.greatest(int_div(d, SMOOTHING), F.lit(-step).cast("bigint")), F.lit(step).cast("bigint"))
    action = (
        F.when(F.lit(not enabled) | (F.abs(d) < max(1, rate // DEADBAND_DIVISOR)), "none")
        .when(d > max_gap, "insert")
        .when(-d > max_gap, "drop")
        .when(soft == 0, "none")
        .otherwise("compensate")
    )
    amount = (
        F.when(action == "none", F.lit(0).cast("bigint"))
        .when(action == "insert", d)
        .when(action == "drop", -d)
        .otherwise(soft)
    )
    return df.withColumn("action", action).withColumn("amount", amount)


def _advance(counted: int, expected: int, units: int, band: int) -> int:
    """Counted units after one block: inserts jump to the expected position, drops wait for it."""
    if counted < expected - band:
        return expected + units
    if counted <= expected + band:
        return counted + units
    return max(expected + units, counted)


class Rule(NamedTuple):
    """How a block moves the counted clock; ``step`` is 0 while soft compensation does not move it."""

    band: int
    deadband: int = 0
    step: int = 0

    @classmethod
    def of(cls, rate: int, max_gap: int, closed_loop: bool = False) -> Rule:
        deadband = max(1, rate // DEADBAND_DIVISOR)
        return cls(max(max_gap, deadband - 1), deadband, rate // STEP_DIVISOR if closed_loop else 0)

    def advance(self, counted: int, expected: int, units: int) -> int:
        behind = expected - counted
        if not self.step or not self.deadband <= abs(behind) <= self.band:
            return _advance(counted, expected, units, self.band)
        soft = min(abs(behind) // SMOOTHING, self.step)
        return counted + units + (soft if behind > 0 else -soft)

    def advance_all(self, counted: int, expected: Iterable[int], units: Iterable[int]) -> int:
        for e, m in zip(expected, units, strict=True):
            counted = self.advance(counted, e, m)
        return counted

    def regions(self, e: int, m: int) -> list[tuple[int | None, Op]]:
        """Stretches of the counted position as (first position, what happens there), from below."""
        if not self.step:
            out = [(None, ("set", e + m, 0)), (e - self.band, ("shift", m, 0))]
        else:
            # Behind by ``full`` units or more, compensation is the largest step.
            full = SMOOTHING * self.step
            out = [(None, ("set", e + m, 0))]
            if self.band >= max(full, self.deadband):
                out.append((e - self.band, ("shift", m + self.step, 0)))
            eased = min(self.band, full - 1)
            if eased >= self.deadband:
                out.append((e - eased, ("ease_up", e, m)))
            out.append((e - self.deadband + 1, ("shift", m, 0)))
            if eased >= self.deadband:
                out.append((e + self.deadband, ("ease_down", e, m)))
            if self.band >= max(full, self.deadband):
                out.append((e + max(full, self.deadband), ("shift", m - self.step, 0)))
        above = e + self.band + 1
        if e + m >= above:
            out.append((above, ("set", e + m, 0)))
        out.append((max(above, e + m), ("shift", 0, 0)))
        return out


def _replay(counted: int, expected: Iterable[int], units: Iterable[int], rule: Rule) -> list[int]:
    before = []
    for e, m in zip(expected, units, strict=True):
        before.append(counted)
        counted = rule.advance(counted, e, m)
    return before


#: What happens to a position: set to a value, shifted, or moved an eighth of its way up or down to the expected one.
Op = tuple[str, int, int]
Piece = tuple[int, int, bool, int]

#: Images of at most so many values are held value by value once they were eased.
_FEW = 16


def _apply(op: Op, x: int) -> int:
    kind, a, m = op
    if kind == "shift":
        return x + a
    if kind == "ease_up":
        return x + (a - x) // SMOOTHING + m
    if kind == "ease_down":
        return x - (x - a) // SMOOTHING + m
    return a


def _first_reaching(op: Op, y: int) -> int:
    """The smallest position that ``op``, which never falls and rises by one at most, takes to ``y`` or above."""
    kind, a, m = op
    if kind == "shift":
        return y - a
    if kind == "ease_up":
        return -((a - SMOOTHING * (y - m)) // (SMOOTHING - 1))
    return (SMOOTHING * (y - m - 1) - a) // (SMOOTHING - 1) + 1


class _Wide(NamedTuple):
    """Start positions ``low`` to ``high`` that have gone through the same steps, and where the two ends are now."""

    low: int
    high: int
    ops: tuple  # linked from the last one: (op, ops before), () at the start
    at: int
    to: int
    eased: bool = False

    def then(self, op: Op) -> _Wide:
        at, to, ops = _apply(op, self.at), _apply(op, self.to), self.ops
        if op[0] == "shift" and ops and ops[0][0] == "shift":
            op, ops = ("shift", ops[0][1] + op[1], 0), ops[1]
        return _Wide(self.low, self.high, (op, ops), at, to, self.eased or op[0] != "shift")

    def start_of(self, y: int) -> int:
        """The first start position that is at ``y`` or above now."""
        ops = self.ops
        while ops:
            y, ops = _first_reaching(ops[0], y), ops[1]
        return y


class Transfer:
    """The map from the counted position before some blocks, in [low, high], to the position after them.

    It is held as stretches of start positions, so its size follows the cuts and not the width of [low, high]. Where a
    block sets positions they become one value; where it shifts or eases them a stretch only notes the step, and its
    ends tell what it covers, as no step skips a value upwards. A cut is carried back to start positions through the
    inverses of the steps. Easing shrinks a stretch by an eighth, so it has few such steps until it is held value by
    value; values that become equal are one from then on.

    Most stretches lie where a block shifts everything alike. They are kept relative to one common offset, sorted by
    both ends (two heaps), and a block only touches those that reach beyond.
    """

    def __init__(self, low: int, high: int, rule: Rule):
        self.rule, self.offset, self.reach = rule, 0, rule.deadband - 1 if rule.step else rule.band
        self.below: list[tuple[int, int]] = []
        self.above: list[tuple[int, int]] = []
        self.wide: dict[int, tuple[_Wide, int]] = {}  # and the offset when it was put there
        self.value: dict[int, int] = {}  # of points, relative to the offset
        self.point_at: dict[int, int] = {}
        self.same: list[int] = []  # of ids: the point that took its value
        self.starts: list[tuple[int, int, int]] = []
        self._keep(_Wide(low, high, (), low, high))

    def _id(self) -> int:
        self.same.append(len(self.same))
        return len(self.same) - 1

    def _root(self, point: int) -> int:
        while self.same[point] != point:
            self.same[point] = self.same[self.same[point]]
            point = self.same[point]
        return point

    def _rest(self, number: int, at: int, to: int) -> None:
        heapq.heappush(self.below, (at - self.offset, number))
        heapq.heappush(self.above, (self.offset - to, number))

    def _place(self, point: int, value: int) -> None:
        rest = value - self.offset
        held = self.point_at.setdefault(rest, point)
        if held != point:
            self.same[point] = held
            return
        self.value[point] = rest
        self._rest(point, value, value)

    def _point(self, low: int, high: int, value: int) -> None:
        point = self._id()
        self.starts.append((low, high, point))
        self._place(point, value)

    def _keep(self, piece: _Wide) -> None:
        if piece.at == piece.to:
            self._point(piece.low, piece.high, piece.at)
        elif piece.to - piece.at <= _FEW and piece.eased:
            low = piece.low
            for value in range(piece.at, piece.to + 1):
                high = piece.high if value == piece.to else piece.start_of(value + 1) - 1
                self._point(low, high, value)
                low = high + 1
        else:
            number = self._id()
            self.wide[number] = (piece, self.offset)
            self._rest(number, piece.at, piece.to)

    def _take(self, heap: list[tuple[int, int]], found: list) -> None:
        """Take the first of a heap out, as a point with its value or a stretch; it may be gone already."""
        rest, number = heapq.heappop(heap)
        if number in self.wide:
            piece, before = self.wide.pop(number)
            found.append(piece.then(("shift", self.offset - before, 0)) if self.offset != before else piece)
        elif number in self.value and abs(rest) == abs(self.value[number]):
            rest = self.value.pop(number)
            del self.point_at[rest]
            found.append((number, rest + self.offset))

    def block(self, e: int, m: int) -> None:
        found: list = []
        while self.below and self.below[0][0] + self.offset < e - self.reach:
            self._take(self.below, found)
        while self.above and self.offset - self.above[0][0] > e + self.reach:
            self._take(self.above, found)
        self.offset += m
        regions = None
        for one in found:
            if isinstance(one, _Wide):
                regions = regions or self.rule.regions(e, m)
                self._cut(one, regions)
            else:
                self._place(one[0], self.rule.advance(one[1], e, m))

    def _cut(self, piece: _Wide, regions: list[tuple[int | None, Op]]) -> None:
        low, at = piece.low, piece.at
        for i, (_, op) in enumerate(regions):
            end = regions[i + 1][0] if i + 1 < len(regions) else None
            if end is not None and at >= end:
                continue
            last = end is None or piece.to < end
            high = piece.high if last else piece.start_of(end) - 1
            to = piece.to if last else end - 1
            if op[0] == "set":
                self._point(low, high, op[1])
            else:
                self._keep(_Wide(low, high, piece.ops, at, to, piece.eased).then(op))
            if last:
                return
            low, at = high + 1, end

    def pieces(self) -> list[tuple[int, int, list[Op]]]:
        """Stretches of start positions and the steps they take, neighbours that take the same ones joined."""
        out: list[tuple[int, int, list[Op]]] = []
        for low, high, point in self.starts:
            out.append((low, high, [("set", self.value[self._root(point)] + self.offset, 0)]))
        for piece, before in self.wide.values():
            steps, ops = [], piece.then(("shift", self.offset - before, 0)).ops
            while ops:
                steps.append(ops[0])
                ops = ops[1]
            out.append((piece.low, piece.high, steps[::-1]))
        joined: list[tuple[int, int, list[Op]]] = []
        for low, high, steps in sorted(out):
            if joined and joined[-1][2] == steps:
                joined[-1] = (joined[-1][0], high, steps)
            else:
                joined.append((low, high, steps))
        return joined


def _transfer_pieces(
    low: int, high: int, expected: Iterable[int], units: Iterable[int], rule: Rule
) -> list[tuple[int, int, list[Op]]]:
    transfer = Transfer(low, high, rule)
    for e, m in zip(expected, units, strict=True):
        transfer.block(e, m)
    return transfer.pieces()


def _transfer(low: int, high: int, expected: Iterable[int], units: Iterable[int], band: int) -> list[Piece]:
    """The same without easing: stretches (low, high, constant?, value or shift)."""
    pieces = _transfer_pieces(low, high, expected, units, Rule(band))
    return [
        (a, b, True, steps[0][1]) if steps and steps[0][0] == "set" else (a, b, False, sum(s[1] for s in steps))
        for a, b, steps in pieces
    ]


def _evaluate(pieces: Iterable[dict], counted: int) -> int:
    for p in pieces:
        if p["low"] <= counted <= p["high"]:
            return int(p["v"]) if p["constant"] else int(counted + p["v"])
    raise ValueError("counted position outside its bounds")


def _follow(pieces: Sequence[dict], counted: int) -> int:
    """Where a part takes a position; its pieces are in order."""
    place = bisect.bisect_right(pieces, counted, key=lambda p: p["low"]) - 1
    if place < 0 or counted > pieces[place]["high"]:
        raise ValueError("counted position outside its bounds")
    for s in pieces[place]["steps"]:
        counted = _apply((s["kind"], int(s["a"]), int(s["m"])), counted)
    return int(counted)


_PIECES = "array<struct<low bigint, high bigint, steps array<struct<kind string, a bigint, m bigint>>>>"


def _carried_counts(rows: DataFrame, keys: list[str], order: list[str], rule: Rule) -> DataFrame:
    """Counted units at the start of every part, without replaying earlier parts.

    A block sets, shifts or eases the counted position by stretches, and such maps compose, so each part is reduced
    to one map of few stretches in parallel (``Transfer``). The position entering a part lies between bounds known
    from the blocks before it, an interval about two correction bands wide. The maps of a stream - one per part -
    are then folded in order.
    """
    band = rule.band
    low = F.col("expected") - band + F.col("units")
    high = F.col("expected") + band + F.col("units")
    rank = F.struct(*order, low.alias("low"))
    parts = W.partitionBy(*keys).orderBy(PART)
    bounds = (
        rows.groupBy(*keys, PART)
        .agg(F.max(rank)["low"].alias("low"), F.max(high).alias("high"))
        .select(
            *keys,
            PART,
            F.coalesce(F.lag("low").over(parts), F.lit(0).cast("bigint")).alias("low"),
            F.greatest(F.max("high").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("high"),
        )
        .withColumn("low", F.least("low", "high"))
    )

    def reduce_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        head = pdf.iloc[0]
        pieces = _transfer_pieces(
            int(head["low"]), int(head["high"]), pdf["expected"].tolist(), pdf["units"].tolist(), rule
        )
        out = pdf.iloc[:1][[*keys, PART]].copy()
        named = [(low, high, [dict(zip(("kind", "a", "m"), s, strict=True)) for s in steps]) for low, high, steps in pieces]
        out["pieces"] = [[dict(zip(("low", "high", "steps"), p, strict=True)) for p in named]]
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PART)
        counted, starts = 0, []
        for pieces in pdf["pieces"]:
            starts.append(counted)
            counted = _follow(pieces, counted)
        return pdf[[*keys, PART]].assign(start=np.array(starts, dtype="int64"))

    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, PART])
    columns = [*keys, PART, *order, "expected", "units"]
    maps = (
        rows.select(*columns)
        .join(bounds, [*keys, PART])
        .groupBy(*keys, PART)
        .applyInPandas(reduce_part, f"{key_types}, pieces {_PIECES}")
    )
    return maps.groupBy(*keys).applyInPandas(fold, f"{key_types}, start bigint")


def _corrected_clock(rows: DataFrame, n: Column, rule: Rule, hot_rows: int) -> DataFrame:
    """Add ``counted``, null for blocks without live units."""
    keys, order = list(STREAM_KEYS), ["us", "seq"]
    cut = ordered(rows, keys, order, hot_rows=hot_rows)
    parted = cut.parted()
    remaining = n - F.col("skipped")
    if cut.split:
        live = parted.filter(F.col("skipped") < n).select(
            *keys, PART, *order, "expected", remaining.alias("units")
        )
        # A part of trimmed blocks only has no starting position, and needs none.
        parted = parted.join(_carried_counts(live, keys, order, rule), [*keys, PART], "left")
    else:
        parted = parted.withColumn("start", F.lit(0).cast("bigint"))
    parted = parted.withColumn("_remaining", remaining).withColumn("counted", F.lit(None).cast("bigint"))

    def replay(part: pa.Table) -> pa.Table:
        """The rows of a part with their clock; rows of equal time and number stay as many as they are."""
        part = part.sort_by([(c, "ascending") for c in (*order, "expected", "_remaining")])
        left = part["_remaining"].to_numpy()
        live = left > 0
        counted = np.zeros(len(left), dtype="int64")
        if live.any():
            start = part["start"].to_pylist()[int(np.argmax(live))]
            counted[live] = _replay(start, part["expected"].to_numpy()[live].tolist(), left[live].tolist(), rule)
        place = part.schema.get_field_index("counted")
        return part.set_column(place, "counted", pa.array(counted, pa.int64(), mask=~live))

    return parted.groupBy(*keys, PART).applyInArrow(replay, parted.schema).drop("start", "_remaining", PART)


def apply_corrections(
    df: DataFrame,
    rate: int,
    max_gap: int,
    tb_us: int = US_PER_SEC,
    units: str = "units",
    hot_rows: int = 1_000_000,
    enabled: bool = True,
    closed_loop: bool = False,
) -> DataFrame:
    """Trim, measure the drift and correct it block by block; the clock follows what was inserted or dropped.

    Needs ``t0`` (the anchor). Blocks wholly before ``t0`` are kept with action ``trimmed``. Soft compensation
    does not move the clock unless ``closed_loop`` is on: then it moves by the compensated units, so that what was
    corrected is not measured again. Adds skipped, expected, counted, drift, action, amount and emitted units.

    With ``enabled`` off nothing is corrected, and the clock is the running sum of the units that come in.

    The clock is a true recurrence per stream. Streams of at most ``hot_rows`` blocks are replayed in one
    group; a longer stream is cut into parts whose starting positions are computed in parallel.
    """
    keys, order = list(STREAM_KEYS), ["us", "seq"]
    start, n = F.col("us") - F.col("t0"), F.col(units).cast("bigint")
    skipped = F.greatest(units_in(-start, rate, tb_us), F.lit(0).cast("bigint"))
    rows = df.withColumn("skipped", F.least(skipped, n))
    rows = rows.withColumn("expected", units_in(start + us_of_units(F.col("skipped"), rate, tb_us), rate, tb_us))
    if enabled:
        out = _corrected_clock(rows, n, Rule.of(rate, max_gap, closed_loop), hot_rows)
    else:
        came = ordered(rows, keys, order, hot_rows=hot_rows)
        came = came.scan(counted=running_sum(n - F.col("skipped"), inclusive=False)).result()
        out = came.withColumn("counted", F.when(F.col("skipped") < n, F.col("counted")))
    out = out.withColumn("drift", F.col("expected") - F.col("counted"))
    out = plan_correction(out, rate, max_gap, enabled)
    remaining, trimmed = n - F.col("skipped"), F.col("counted").isNull()
    dropped = F.when(F.col("action") == "drop", F.least(F.col("amount"), remaining)).otherwise(F.lit(0))
    return (
        out.withColumn("emitted", F.when(trimmed, F.lit(0).cast("bigint")).otherwise(remaining - dropped))
        .withColumn(
            "amount",
            F.when(trimmed, F.lit(0).cast("bigint"))
            .when(F.col("action") == "drop", F.least(F.col("amount"), remaining))
            .otherwise(F.col("amount")),
        )
        .withColumn("action", F.when(trimmed, "trimmed").otherwise(F.col("action")))
    )


def leads(df: DataFrame, start: str = "t0") -> DataFrame:
    """Media position minus elapsed wall time of every update."""
    return df.withColumn("lead_us", (F.col("media_us") - F.col(start)) - (F.col("us") - F.col(start)))


def relative_drift(
    left: DataFrame,
    right: DataFrame,
    warmup_us: int = US_PER_SEC,
    hot_rows: int | None = None,
    rows_bound: int | None = None,
) -> DataFrame:
    """Drift of the right stream against the left one, corrected by the first gap after the warm-up.

    Both sides have session_id, us, seq, lead_us and elapsed_us. A constant latency is not drift; the result
    is 0 until the baseline is known and null while one side has not reported.
    """
    def packed(df: DataFrame) -> DataFrame:
        return df.withColumn("value", F.struct("lead_us", "elapsed_us"))

    rows = asof_scan(packed(left), packed(right), "value", "session_id", hot_rows, rows_bound)
    elapsed = F.coalesce("left_value", "right_value")["elapsed_us"]
    gap = F.col("latest_right.lead_us") - F.col("latest_left.lead_us")
    rows = rows.with_columns(elapsed_us=elapsed, gap_us=gap)
    rows = rows.scan(baseline_us=first_value(F.when(F.col("elapsed_us") >= warmup_us, F.col("gap_us"))))
    drift_us = F.when(F.col("baseline_us").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.col("gap_us") - F.col("baseline_us")
    )
    return rows.result().select(
        "session_id", "us", "side", "seq", "elapsed_us", "gap_us", "baseline_us",
        F.when(F.col("gap_us").isNotNull(), drift_us).alias("drift_us"),
    )


def segment_by_gap(df: DataFrame, duration: Column, max_gap_us: int, hot_rows: int | None = None) -> DataFrame:
    """Flag a break where a row does not start where its predecessor ended, and number the segments."""
    rows = ordered(df.withColumn("_end", F.col("us") + duration), STREAM_KEYS, ["us", "seq"], hot_rows=hot_rows)
    rows = rows.scan(expected_us=lag("_end"))
    jump = F.abs(F.col("us") - F.col("expected_us")) > max_gap_us
    rows = rows.with_columns(discontinuity=F.coalesce(jump, F.lit(False)))
    rows = rows.scan(segment=running_sum(F.col("discontinuity").cast("bigint")))
    return rows.result().drop("_end")


def clock_check(df: DataFrame, rate: int, tol_us: int, drift_tol_us: int, tb_us: int = US_PER_SEC) -> DataFrame:
    """Last counted position against wall duration, and the largest drift (needs counted, drift_us, anchor)."""
    media = us_of_units(F.max(F.col("counted")), rate, tb_us)
    wall = F.max("us") - F.min("anchor_us")
    checked = df.groupBy(*STREAM_KEYS).agg(
        media.alias("media_us"), wall.alias("wall_us"), F.max(F.abs("drift_us")).alias("max_drift_us")
    )
    return checked.withColumn("clock_ok", F.abs(F.col("media_us") - F.col("wall_us")) < tol_us).withColumn(
        "drift_ok", F.col("max_drift_us") < drift_tol_us
    )
