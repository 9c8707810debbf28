"""State processors: start barrier and release, gap fill, drift correction, thinning, merge, blocks, status rows.

Rows of one key are ordered inside a micro-batch; across micro-batches they are taken as they come.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
from collections.abc import Collection, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from streamgrid.functions.scalars import US_PER_SEC
from streamgrid.operators.drift import Rule

FILL_OUTPUT = (
    "session_id string, stream_id string, slot bigint, slot_to bigint, status string, us bigint, seq bigint, "
    "value double, superseded bigint, late bigint, lost bigint"
)
CLOCK_OUTPUT = "session_id string, stream_id string, us bigint, seq bigint, expected bigint, units bigint, counted bigint"
BARRIER_OUTPUT = "session_id string, t0 bigint, streams bigint, timed_out boolean"
RELEASE_OUTPUT = "session_id string, salt int, t0 bigint, ts timestamp"
THIN_OUTPUT = "session_id string, stream_id string, us bigint, seq bigint, value double"

MAX_FILL_ROWS = 10_000
MAX_FRAME_ROWS = 10_000


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by)


class FillProcessor(StatefulProcessor):
    """Repeats the previous slot in gaps; keeps one row of state per stream.

    The input has one row per (stream, slot), so even a hot stream sends at most one row per period. With ``idle_us``
    the state of a stream ends when it has been silent for that long.
    """

    def __init__(self, max_fill: int, idle_us: int | None = None):
        self.max_fill, self.idle_us = max_fill, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ending = Ending(handle, self.idle_us)
        schema = T.StructType([
            T.StructField("slot", T.LongType()),
            T.StructField("us", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("value", T.DoubleType()),
        ])
        self.previous = handle.getValueState("previous", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots = _ordered(rows, ["slot"])
        self.ending.saw(int(slots["us"].max()))
        last = self.previous.get() if self.previous.exists() else None
        out = []
        for r in slots.itertuples(index=False):
            gap = 0 if last is None else r.slot - last[0] - 1
            if gap > self.max_fill:
                out.append((*key, last[0] + 1, r.slot - 1, "skipped", None, None, None, 0, 0, gap))
            else:
                for s in range(r.slot - gap, r.slot):
                    out.append((*key, s, s, "filled", last[1], last[2], last[3], 0, 0, 0))
            out.append((*key, r.slot, r.slot, "fresh", r.us, r.seq, r.value, r.superseded, r.late, 0))
            last = (int(r.slot), int(r.us), int(r.seq), float(r.value))
            if len(out) >= MAX_FILL_ROWS:
                yield self._frame(out)
                out = []
        self.previous.update(last)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ending.is_over(timerValues):
            self.previous.clear()
        yield from ()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        columns = [c.split()[0] for c in FILL_OUTPUT.split(", ")]
        frame = pd.DataFrame(rows, columns=columns)
        return frame.astype({"us": "Int64", "seq": "Int64"})

    def close(self) -> None:
        pass


class Ending:
    """A timer per key that ends its state once the watermark is ``idle_us`` behind its latest row.

    The timer is set once and, when it fires early, set again for the rest, so a busy key costs no timer per batch.
    """

    def __init__(self, handle: StatefulProcessorHandle, idle_us: int | None):
        self.handle, self.idle_us = handle, idle_us
        if idle_us is not None:
            self.latest = handle.getValueState("latest", T.StructType([T.StructField("us", T.LongType())]))

    def saw(self, us: int) -> None:
        if self.idle_us is None:
            return
        known = self.latest.get()[0] if self.latest.exists() else None
        if known is None:
            self.handle.registerTimer(self._expiry(us))
        if known is None or us > known:
            self.latest.update((us,))

    def is_over(self, timerValues) -> bool:
        """Whether the key is idle; clears what this class holds, or sets the next timer."""
        if self.idle_us is None or not self.latest.exists():
            return False
        due = self._expiry(self.latest.get()[0])
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return False
        self.latest.clear()
        return True

    def _expiry(self, us: int) -> int:
        return (us + self.idle_us) // 1000 + 1


class Held:
    """What is kept of a key (None: nothing) and when, in ms of event time, the key has to be asked again."""

    __slots__ = ("due", "state")

    def __init__(self, state=None, due: int | None = None):
        self.state, self.due = state, due


def _expiry(us: int | None, idle_us: int | None) -> int | None:
    """When a key that was last seen at ``us`` has been silent for ``idle_us``."""
    return None if us is None or idle_us is None else (us + idle_us) // 1000 + 1


def _latest(known: int | None, us: int) -> int:
    return us if known is None else max(known, us)


def _earliest(*dues: int | None) -> int | None:
    return min((d for d in dues if d is not None), default=None)


class KeyLogic:
    """What is done with the rows of one key; rows come and go as tuples in the order of ``columns`` and ``output``.

    ``on_rows`` and ``on_time`` change ``held`` and give rows. ``on_time`` is called once the watermark reaches
    ``held.due`` and has to set the next one.
    """

    columns: tuple[str, ...]
    output: str

    def on_rows(self, key: tuple, rows: list[tuple], held: Held, watermark_ms: int) -> Iterator[tuple]:
        raise NotImplementedError

    def on_time(self, key: tuple, held: Held, watermark_ms: int) -> Iterator[tuple]:
        held.due = None
        yield from ()


class BucketProcessor(StatefulProcessor):
    """Runs a ``KeyLogic`` for all keys of a bucket (a hash of the keys) in one call.

    A call, a state access and a frame cost milliseconds each, whatever they hold. So the keys of a bucket are read and
    written together, and their rows leave in common frames. State has a row per key that holds something.
    """

    def __init__(self, logic: KeyLogic, keys: Sequence[str], whole: Collection[str]):
        self.logic, self.keys, self.whole = logic, tuple(keys), frozenset(whole)
        pairs = [c.split() for c in logic.output.split(", ")]
        self.names = [n for n, _ in pairs]
        self.types = {n: {"bigint": "Int64", "int": "Int32"}[t] for n, t in pairs if t in ("bigint", "int")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [("due", T.LongType()), ("held", T.BinaryType())]
        self.state = handle.getListState("keys", T.StructType([T.StructField(n, t) for n, t in fields]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._frames(self._take(rows, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frames(self._wake(timerValues.getCurrentWatermarkInMs()))

    def _take(self, frames: Iterable[pd.DataFrame], now: int) -> Iterator[tuple]:
        arrived: dict[tuple, list[tuple]] = {}
        places = [self.logic.columns.index(k) for k in self.keys]
        for frame in frames:
            for row in zip(*[self._values(frame[c]) for c in self.logic.columns], strict=True):
                arrived.setdefault(tuple(row[i] for i in places), []).append(row)
        known = self._load()
        for key, found in arrived.items():
            yield from self.logic.on_rows(key, found, known.setdefault(key, Held()), now)
        self._store(known)

    def _wake(self, now: int) -> Iterator[tuple]:
        known = self._load()
        due = [(k, h) for k, h in known.items() if h.due is not None and h.due <= now]
        for key, held in due:
            yield from self.logic.on_time(key, held, now)
        if due:
            self._store(known)

    def _values(self, column: pd.Series) -> list:
        """Whole numbers stay whole where nulls made them floats; what is missing is None."""
        if isinstance(column.dtype, np.dtype) and column.dtype.kind in "iub":
            return column.tolist()
        if column.name in self.whole:
            return [None if pd.isna(v) else int(v) for v in column]
        return [None if v is pd.NA or (isinstance(v, float) and v != v) else v for v in column.tolist()]

    def _load(self) -> dict[tuple, Held]:
        if not self.state.exists():
            return {}
        out = {}
        for due, held in self.state.get():
            key, state = pickle.loads(bytes(held))
            out[key] = Held(state, None if due is None or due != due else int(due))
        return out

    def _store(self, known: dict[tuple, Held]) -> None:
        kept = {k: h for k, h in known.items() if h.state is not None}
        if not kept:
            self.state.clear()
            return
        self.state.put([(h.due, pickle.dumps((k, h.state))) for k, h in kept.items()])
        due = _earliest(*(h.due for h in kept.values()))
        if due is not None:
            self.handle.registerTimer(due)

    def _frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while some := list(itertools.islice(rows, MAX_FRAME_ROWS)):
            yield pd.DataFrame(some, columns=self.names).astype(self.types)

    def close(self) -> None:
        pass


class Clock(KeyLogic):
    """The counted clock of a stream under insertion and dropping; state is the counted position.

    Without ``idle_us`` state stays for good; with it, it ends when a stream has been silent for that long.
    """

    def __init__(self, rule: Rule, idle_us: int | None = None, output: str = CLOCK_OUTPUT):
        self.rule, self.idle_us, self.output = rule, idle_us, output
        self.columns = tuple(c.split()[0] for c in output.split(", "))[:-1]
        self.places = [self.columns.index(c) for c in ("us", "seq", "expected", "units")]

    def on_rows(self, key, rows, held, watermark_ms):
        us, seq, expected, units = self.places
        rows.sort(key=lambda r: (r[us], r[seq]))
        counted, latest = held.state or (0, None)
        for row in rows:
            # A block that was trimmed has no units and leaves the clock alone.
            live = row[units] > 0
            yield (*row, counted if live else None)
            counted = self.rule.advance(counted, row[expected], row[units]) if live else counted
        latest = _latest(latest, rows[-1][us])
        held.state, held.due = (counted, latest), _expiry(latest, self.idle_us)

    def on_time(self, key, held, watermark_ms):
        held.state = held.due = None
        yield from ()


class Barrier(KeyLogic):
    """Resolves the common origin of a session once all participants reported, or after a timeout.

    Input rows are first and last times per stream (null for a stream that withdraws). The timeout is event time after
    the earliest report, and streams that start later than that do not decide, as in the batch form.

    Output is one row per session; with ``salts``, the origin for every salt instead, again in every micro-batch that
    brings rows of the session, dated no earlier than the watermark allows. So who waits for an origin meets it in the
    micro-batch of the rows and holds no origins. With ``idle_us`` a session's state ends when it has been silent.

    State is the first time of every stream until the origin is known, then the origin alone, and the latest row.
    """

    columns = ("session_id", "stream_id", "first_us", "last_us")

    def __init__(self, participants: int, timeout_us: int, salts: int = 0, idle_us: int | None = None):
        self.participants, self.timeout_us, self.salts = participants, timeout_us, salts
        self.idle_us = None if idle_us is None else idle_us + timeout_us
        self.output = RELEASE_OUTPUT if salts else BARRIER_OUTPUT

    def on_rows(self, key, rows, held, watermark_ms):
        t0, firsts, latest = held.state or (None, {}, None)
        last = max((r[3] for r in rows if r[3] is not None), default=None)
        if last is not None:
            latest = _latest(latest, last)
        if t0 is not None:
            held.state = (t0, {}, latest)
            held.due = _expiry(latest, self.idle_us)
            if self.salts and last is not None:
                yield from self._announce(key, t0, last, watermark_ms)
            return
        for _, stream, first, _ in rows:
            known = firsts.get(stream)
            firsts[stream] = first if known is None else known if first is None else min(known, first)
        earliest = min((v for v in firsts.values() if v is not None), default=None)
        if earliest is not None and len(firsts) >= self.participants:
            # What decides may be only that a stream withdraws; then the timeout dates the origin.
            known = earliest + self.timeout_us if last is None else last
            yield from self._resolve(key, held, firsts, latest, False, known, watermark_ms)
            return
        held.state = (None, firsts, latest)
        held.due = _earliest(_expiry(earliest, self.timeout_us), _expiry(latest, self.idle_us))

    def on_time(self, key, held, watermark_ms):
        t0, firsts, latest = held.state
        earliest = min((v for v in firsts.values() if v is not None), default=None)
        if t0 is None and earliest is not None and _expiry(earliest, self.timeout_us) <= watermark_ms:
            yield from self._resolve(key, held, firsts, latest, True, earliest + self.timeout_us, watermark_ms)
        held.due = _expiry(latest, self.idle_us)
        if held.due is not None and held.due <= watermark_ms:
            held.state = held.due = None

    def _resolve(self, key, held, firsts, latest, timed_out, at_us, watermark_ms):
        known = [v for v in firsts.values() if v is not None]
        in_time = [v for v in known if v <= min(known) + self.timeout_us]
        t0 = max(in_time)
        held.state, held.due = (t0, {}, latest), _expiry(latest, self.idle_us)
        if self.salts:
            yield from self._announce(key, t0, at_us, watermark_ms)
        else:
            yield (*key, t0, len(in_time), timed_out or len(in_time) < len(known))

    def _announce(self, key, t0, at_us, watermark_ms):
        # What is dated before the watermark would be refused.
        ts = pd.Timestamp(max(at_us, watermark_ms * 1000) * 1000)
        for salt in range(self.salts):
            yield (*key, salt, t0, ts)


class Release(KeyLogic):
    """Holds the rows of a (session, salt) until the origin of the session is announced, then lets them go with it.

    The announcement comes again with every micro-batch that has rows, so nothing is kept once rows have left.
    Released rows are dated ``timeout`` later: so long a row may have waited.
    """

    def __init__(self, fields: list[T.StructField], timeout_us: int):
        names = [f.name for f in fields]
        self.timeout_us, self.width, self.us = timeout_us, len(fields), names.index("us")
        self.columns = (*names, "salt", "t0", "is_origin")
        types = [f.dataType.simpleString() for f in fields]
        self.output = ", ".join([*(f"{n} {t}" for n, t in zip(names, types, strict=True)), "t0 bigint", "ready_ts timestamp"])

    def on_rows(self, key, rows, held, watermark_ms):
        # A filter on the session before this would be pushed below the watermark, which end marks are there to move.
        if key[0] is None:
            return
        t0 = next((r[-2] for r in rows if r[-1]), None)
        waiting = [r[: self.width] for r in rows if not r[-1]]
        if t0 is None:
            held.state = [*(held.state or []), *waiting]
            return
        for row in itertools.chain(held.state or [], waiting):
            yield (*row, t0, pd.Timestamp((row[self.us] + self.timeout_us + 1000) * 1000))
        held.state = None


class Grid(KeyLogic):
    """Bounded gap fill on slots that may come in two portions, as a slot may lie in two windows of release.

    The newest slot of a stream waits for its other portion: until a later slot comes, or the watermark passes it.
    State is the last slot that left, the one that waits, and the latest row.
    """

    columns = ("session_id", "stream_id", "slot", "us", "seq", "value", "rows", "t0")
    output = FILL_OUTPUT

    def __init__(self, max_fill: int | None, period_us: int, timeout_us: int, idle_us: int | None = None):
        self.max_fill, self.period_us, self.timeout_us = max_fill, period_us, timeout_us
        self.idle_us = None if idle_us is None else idle_us + timeout_us

    def on_rows(self, key, rows, held, watermark_ms):
        previous, pending, latest = held.state or (None, None, None)
        for now in sorted((r[2:] for r in rows), key=lambda r: r[:3]):
            latest = _latest(latest, now[1])
            if pending is not None and pending[0] == now[0]:
                newest = max(pending, now, key=lambda p: p[1:3])
                pending = (*newest[:4], pending[4] + now[4], now[5])
                continue
            if pending is not None:
                yield from self._emit(key, previous, pending)
                previous = pending[:4]
            pending = now
        self._keep(held, previous, pending, latest)

    def on_time(self, key, held, watermark_ms):
        previous, pending, latest = held.state
        if pending is not None and self._due(pending) <= watermark_ms:
            yield from self._emit(key, previous, pending)
            previous, pending = pending[:4], None
        self._keep(held, previous, pending, latest)
        if pending is None and held.due is not None and held.due <= watermark_ms:
            held.state = held.due = None

    def _keep(self, held, previous, pending, latest):
        held.state = (previous, pending, latest)
        held.due = _expiry(latest, self.idle_us) if pending is None else self._due(pending)

    def _due(self, pending: tuple) -> int:
        """When every window of release that touches the slot has passed."""
        slot, t0 = pending[0], pending[5]
        return (t0 + (slot + 3) * self.period_us + self.timeout_us) // 1000 + 2

    def _emit(self, key, last, slot):
        gap = 0 if last is None else slot[0] - last[0] - 1
        if self.max_fill is not None and gap > self.max_fill:
            yield (*key, last[0] + 1, slot[0] - 1, "skipped", None, None, None, 0, 0, gap)
        else:
            for s in range(slot[0] - gap, slot[0]):
                yield (*key, s, s, "filled", last[1], last[2], last[3], 0, 0, 0)
        yield (*key, slot[0], slot[0], "fresh", slot[1], slot[2], slot[3], slot[4] - 1, 0, 0)


class ThinProcessor(StatefulProcessor):
    """Keeps a row only if it is strictly later than every row kept before; a row without a time is never kept.

    With ``idle_us`` the state of a stream ends when it has been silent for that long.
    """

    def __init__(self, idle_us: int | None = None):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("us", T.LongType())]))
        self.ending = Ending(handle, self.idle_us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, ["arrival_us", "seq"])
        frame = frame[frame["us"].notna()]
        if frame.empty:
            return
        floor = self.kept.get()[0] if self.kept.exists() else None
        before = frame["us"].cummax().shift()
        if floor is not None:
            before = before.fillna(floor).clip(lower=floor)
        kept = frame[before.isna() | (frame["us"] > before)]
        top = int(frame["us"].max())
        self.kept.update((top if floor is None else max(top, floor),))
        self.ending.saw(top)
        yield kept[["session_id", "stream_id", "us", "seq", "value"]].astype({"us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ending.is_over(timerValues):
            self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


MERGE_OUTPUT = (
    "session_id string, kind string, stream_index int, seq bigint, pts bigint, dts bigint, position bigint"
)


class Merge(KeyLogic):
    """Merges the streams of a session by (dts, stream_index, seq) as far as no earlier row can come any more.

    Every stream brings its rows in that order. The frontier is the smallest last row over the open streams; rows up
    to it leave with their position, the others wait. An end mark takes a stream out, so its silence holds up nobody.
    Once all ``participants`` have ended a ``complete`` row tells how many rows there were, and the state is gone.
    """

    columns = ("session_id", "stream_index", "seq", "pts", "dts", "kind")
    output = MERGE_OUTPUT

    def __init__(self, participants: int):
        self.participants = participants

    def on_rows(self, key, rows, held, watermark_ms):
        if key[0] is None:
            return
        packets, streams, before = held.state or ([], {}, 0)
        for _, index, seq, pts, dts, kind in rows:
            last, open_ = streams.get(index, (None, True))
            top = last if dts is None else dts if last is None else max(last, dts)
            streams[index] = (top, open_ and kind != "eof")
            if kind != "eof":
                packets.append((dts, index, seq, pts))
        packets.sort(key=lambda p: p[:3])
        complete = len(streams) >= self.participants
        frontier = min(((v[0], k) for k, v in streams.items() if v[1]), default=None)
        over = complete and frontier is None
        ready = 0 if not complete else len(packets) if over else bisect.bisect_right(packets, frontier, key=lambda p: p[:2])
        for i, p in enumerate(packets[:ready]):
            yield (key[0], "data", p[1], p[2], p[3], p[0], before + i + 1)
        if over:
            yield (key[0], "complete", None, None, None, None, before + ready)
        held.state = None if over else (packets[ready:], streams, before + ready)


BLOCK_OUTPUT = (
    "session_id string, stream_id string, block bigint, pts bigint, channels int, samples array<float>, frames bigint, "
    "is_partial boolean"
)


class BlockProcessor(StatefulProcessor):
    """Cuts the arrays of a stream into blocks of ``size`` frames; state is the part of a block that is not full yet.

    An end mark (a row without samples) brings out what is left as a partial block and ends the state.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [("block", T.LongType()), ("channels", T.IntegerType()), ("samples", T.ArrayType(T.FloatType()))]
        self.carried = handle.getValueState("carried", T.StructType([T.StructField(n, t) for n, t in fields]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = _ordered(rows, ["us", "seq"])
        block, channels, samples = self.carried.get() if self.carried.exists() else (0, 0, [])
        arrays = [s for s in chunks["samples"] if s is not None]
        channels = max([channels, *chunks["channels"].dropna().astype(int)], default=0)
        data = np.concatenate([np.asarray(samples, np.float32), *[np.asarray(a, np.float32) for a in arrays]])
        width = max(1, self.size * channels)
        full = len(data) // width
        out = [(*key, block + i, data[i * width : (i + 1) * width]) for i in range(full)]
        rest = data[full * width :]
        if len(arrays) < len(chunks):
            if len(rest):
                out.append((*key, block + full, rest))
            self.carried.clear()
        else:
            self.carried.update((block + full, channels, [float(x) for x in rest]))
        if out:
            frame = pd.DataFrame(out, columns=["session_id", "stream_id", "block", "samples"])
            frames = frame["samples"].map(len) // max(1, channels)
            yield frame.assign(
                pts=frame["block"] * self.size, channels=channels, frames=frames, is_partial=frames < self.size
            )[[c.split()[0] for c in BLOCK_OUTPUT.split(", ")]]

    def close(self) -> None:
        pass


DASHBOARD_OUTPUT = (
    "session_id string, at_us bigint, received bigint, dropped bigint, bytes bigint, window_secs double, "
    "received_per_sec double, bytes_bits_per_sec double, p50_us bigint, p99_us bigint"
)


class Dashboard(KeyLogic):
    """Status rows of a session: counters and latency quantiles so far, and rates since the row before.

    The input has the counts of a tick per latency bucket, a tick complete in one micro-batch. State is the last
    snapshot and one histogram (as many buckets as the latencies spread over, three digits).
    """

    columns = ("session_id", "at_us", "bucket_high", "received", "dropped", "bytes")
    output = DASHBOARD_OUTPUT

    def __init__(self, idle_us: int | None = None):
        self.idle_us = idle_us

    def on_rows(self, key, rows, held, watermark_ms):
        last, counts = held.state or (None, {})
        rows.sort(key=lambda r: r[1])
        for at_us, tick in itertools.groupby(rows, key=lambda r: r[1]):
            now = [at_us, *(last[1:] if last is not None else (0, 0, 0))]
            for _, _, high, *added in tick:
                if high is not None:
                    counts[high] = counts.get(high, 0) + added[0]
                # A counter is null where all its values of the tick and bucket are.
                now[1:] = [b + (a or 0) for b, a in zip(now[1:], added, strict=True)]
            yield (key[0], *now, *self._rates(last, now), *self._quantiles(counts, 0.5, 0.99))
            last = tuple(now)
        held.state, held.due = (last, counts), _expiry(last[0], self.idle_us)

    @staticmethod
    def _rates(last: tuple | None, now: Sequence[int]) -> tuple:
        if last is None:
            return None, None, None
        seconds = (now[0] - last[0]) / US_PER_SEC
        if seconds <= 0:
            return seconds, 0.0, 0.0
        return seconds, max(now[1] - last[1], 0) / seconds, max(now[3] - last[3], 0) / seconds * 8

    @staticmethod
    def _quantiles(counts: dict[int, int], *quantiles: float) -> list[int | None]:
        highs = sorted(counts)
        upto = list(itertools.accumulate(counts[h] for h in highs))
        return [highs[bisect.bisect_left(upto, upto[-1] * q)] if highs else None for q in quantiles]

    def on_time(self, key, held, watermark_ms):
        held.state = held.due = None
        yield from ()
