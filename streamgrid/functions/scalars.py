"""Integer time arithmetic, unit conversion, formatting and array scalars."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SEC = 1_000_000


def _col(value: Column | str | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _big(value: Column | str | int) -> Column:
    return _col(value).cast("bigint")


def int_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Integer division that truncates toward zero (SQL ``div``)."""
    return F.call_function("div", _col(n), _col(d))


def div_round(n: Column | str | int, d: Column | str | int) -> Column:
    """Nearest integer quotient, halves away from zero, also for negative ``n``. ``d`` must be positive."""
    n, d = _big(n), _big(d)
    half = int_div(d, 2)
    return F.when(n >= 0, int_div(n + half, d)).otherwise(-int_div(half - n, d))


def floor_div(n: Column | str | int, d: Column | str | int) -> Column:
    n, d = _big(n), _big(d)
    return int_div(n - F.pmod(n, d), d)


def ceil_div(n: Column | str | int, d: Column | str | int) -> Column:
    return -floor_div(-_big(n), d)


def slot_of(us: Column | str, origin: Column | str | int, period_us: Column | int) -> Column:
    """Nearest grid slot of an event time."""
    return div_round(_big(us) - _big(origin), period_us)


def deadline_of(
    slot: Column | str, origin: Column | str | int, period_us: Column | int, lookahead_us: Column | int = 0
) -> Column:
    """When a slot leaves; always computed from the origin, so no error accumulates."""
    return _big(origin) + _big(slot) * _big(period_us) + _big(lookahead_us)


def rescale_ts(
    ts: Column | str, from_num: Column | int, from_den: Column | int, to_num: Column | int, to_den: Column | int
) -> Column:
    """Convert a tick count between rational time bases ``num/den``, nearest tick.

    Constant time bases are reduced first and applied to quotient and remainder, which stays in BIGINT; time
    bases given as columns use DECIMAL, so nothing overflows either way.
    """
    parts = (from_num, from_den, to_num, to_den)
    if all(isinstance(p, int) for p in parts):
        ratio = Fraction(from_num * to_den, from_den * to_num)
        if ratio.numerator * ratio.denominator < 2**62:
            ticks, d = _big(ts), ratio.denominator
            if d == 1:
                return ticks * ratio.numerator
            whole = int_div(ticks, F.lit(d).cast("bigint"))
            rest = ticks - whole * d
            return whole * ratio.numerator + div_round(rest * ratio.numerator, d)
    wide = _col(ts).cast("decimal(19,0)")
    n = (wide * (_big(from_num) * _big(to_den)).cast("decimal(18,0)")).cast("decimal(38,0)")
    d = (_big(from_den) * _big(to_num)).cast("decimal(18,0)")
    half = int_div(d, 2).cast("decimal(18,0)")
    return F.when(n >= 0, int_div(n + half, d)).otherwise(-int_div(half - n, d)).cast("bigint")


def ticks_to_seconds(ts: Column | str, num: Column | int, den: Column | int) -> Column:
    return _col(ts).cast("double") * _col(num) / _col(den)


def clamped_latency_us(arrival_ns: Column | str, event_ns: Column | str) -> Column:
    """Latency in microseconds from nanosecond clocks; events dated in the future give 0, a missing time gives null."""
    return int_div(saturate_non_negative(_big(arrival_ns) - _big(event_ns)), 1000)


def saturate_non_negative(value: Column | str) -> Column:
    """Negative values become 0, null stays null."""
    return F.when(_col(value).isNotNull(), F.greatest(_col(value), F.lit(0)))


def frames_of(samples: Column | str, channels: Column | str | int) -> Column:
    """Rows per channel of an interleaved array; 0 when the channel count is 0."""
    channels = _big(channels)
    return F.when(channels == 0, F.lit(0).cast("bigint")).otherwise(int_div(F.size(_col(samples)), channels))


def us_to_seconds(us: Column | str) -> Column:
    return _col(us) / F.lit(1e6)


def us_to_ms(us: Column | str) -> Column:
    return _col(us) / F.lit(1e3)


def bytes_to_bits_per_sec(size: Column | str, seconds: Column | str) -> Column:
    return _col(size) * 8.0 / _col(seconds)


def format_duration(seconds: Column | str) -> Column:
    """``h:mm:ss``; negative durations read 0:00:00, a missing one is null."""
    total = saturate_non_negative(seconds).cast("bigint")
    return F.when(total.isNotNull(), F.format_string("%d:%02d:%02d", int_div(total, 3600), int_div(total, 60) % 60, total % 60))


def _fixed(value: Column, digits: int, unit: str) -> Column:
    """Fixed-point text; ties go to the even digit, where ``format_string`` alone would round them up."""
    return F.format_string(f"%.{digits}f {unit}", F.bround(value, digits))


def format_bitrate(bps: Column | str) -> Column:
    """Whole bits per second, rounded as the double that stands for the scaled rate is."""
    bps = _big(bps)
    return (
        F.when(bps >= 1_000_000, _scaled(bps, 1_000_000, 1, "Mb/s"))
        .when(bps >= 1_000, _scaled(bps, 1_000, 0, "kb/s"))
        .otherwise(F.format_string("%d b/s", bps))
    )


def _scaled(value: Column, unit: int, digits: int, name: str) -> Column:
    """``value / unit`` with up to one digit, rounded by the exact value of that double.

    The remainder decides in whole numbers. In the middle between two texts the double may lie above or below it: it
    is its mantissa over a power of two, and both are whole numbers that can be compared. True ties go to the even.
    """
    step = unit // 10**digits
    low, rest = int_div(value, step), value % step
    double = value.cast("double") / F.lit(float(unit))
    power = F.pow(F.lit(2.0), 52 - F.floor(F.log2(double)))
    exact = lambda c: c.cast("decimal(19,0)").cast("decimal(38,0)")
    side = exact(double * power) * (2 * 10**digits) - exact(power) * (2 * low + 1)
    up = (rest * 2 > step) | ((rest * 2 == step) & ((side > 0) | ((side == 0) & (low % 2 == 1))))
    shown = low + up.cast("bigint")
    if not digits:
        return F.format_string(f"%d {name}", shown)
    return F.format_string(f"%d.%d {name}", int_div(shown, 10), shown % 10)


def format_bytes(size: Column | str) -> Column:
    """Sizes in steps of 1024 up to Gio."""
    size = _big(size)
    return (
        F.when(size < 1024, F.format_string("%d o", size))
        .when(size < 1024**2, _fixed(size / 1024.0, 1, "Kio"))
        .when(size < 1024**3, _fixed(size / 1024.0**2, 1, "Mio"))
        .otherwise(_fixed(size / 1024.0**3, 1, "Gio"))
    )


def align_extension(path: Column | str, extension: str) -> Column:
    """Replace the extension of the last path component unless it already matches, ignoring case.

    A leading dot (``.profile``) is part of the name, not an extension.
    """
    path = _col(path)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem_end = r"(?<=[^/])\.[^./]*$"
    matches = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1)) == extension.lower()
    return F.when(matches, path).otherwise(F.concat(F.regexp_replace(path, stem_end, ""), F.lit("." + extension)))


def force_even(value: Column | str) -> Column:
    """Clear the lowest bit."""
    return _big(value).bitwiseAND(F.lit(-2).cast("bigint"))


# Bytes per pixel layouts; nv12 carries an extra half plane.
PACKED_FORMATS = ("bgrx", "bgra", "rgbx", "rgba")
PLANAR_FORMAT = "nv12"


def raw_volume(stride: Column | str, height: Column | str, pixel_format: Column | str) -> Column:
    """Bytes of one uncompressed observation."""
    plane = _big(stride) * _big(height)
    return F.when(_col(pixel_format) == PLANAR_FORMAT, int_div(plane * 3, 2)).otherwise(plane)


# Errno ENOSPC on Linux, and the error kinds after which going on makes no sense.
ENOSPC = 28
FATAL_KINDS = ("disk_full", "disk_write", "mux", "no_usable_encoder", "pipeline_aborted")
# Result codes that mean "no data yet" or "end of data", not a failure.
BENIGN_KINDS = ("eagain", "eof")


def classify_error(kind: Column | str, errno: Column | str) -> Column:
    """Split write failures into ``disk_full`` and ``disk_write``; other kinds keep their name."""
    kind, errno = _col(kind), _col(errno)
    return (
        F.when((kind == "write") & (errno == ENOSPC), F.lit("disk_full"))
        .when(kind == "write", F.lit("disk_write"))
        .otherwise(kind)
    )


def is_fatal(error_class: Column | str) -> Column:
    return _col(error_class).isin(*FATAL_KINDS)


def is_failure(error_class: Column | str) -> Column:
    return ~_col(error_class).isin(*BENIGN_KINDS)


def gop_size(interval_secs: Column | float, fps: Column | int) -> Column:
    """Slots per independently readable segment: ``max(1, round(interval * fps))``."""
    return F.greatest(F.lit(1).cast("bigint"), F.round(_col_or_lit(interval_secs) * _col_or_lit(fps)).cast("bigint"))


def _col_or_lit(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
