"""Time helpers that stay inside Catalyst and do not depend on the session
time zone (all sample times are ``TIMESTAMP_NTZ``)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# Relative range presets offered by the chart page (label -> seconds).
RANGE_PRESETS = {
    "5m": 300, "30m": 1800, "1h": 3600, "3h": 10800, "6h": 21600, "12h": 43200,
    "1d": 86400, "2d": 172800, "1w": 604800, "1M": 2592000, "3M": 7776000,
    "6M": 15552000, "1Y": 31536000,
}

DEFAULT_RANGE_S = 1800  # default query range when no start is given


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_us(col) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), _c(col))


def epoch_s(col) -> Column:
    """Fractional seconds since the epoch."""
    return epoch_us(col) / F.lit(1_000_000.0)


def from_epoch_us(col) -> Column:
    """TIMESTAMP_NTZ from microseconds since the epoch."""
    return F.timestamp_add("MICROSECOND", _c(col), F.expr(EPOCH_NTZ))


def bucket_start(ts, width_s: int) -> Column:
    """Start of the epoch-aligned bucket of ``width_s`` seconds holding ``ts``."""
    w = int(width_s) * 1_000_000
    return from_epoch_us(F.floor(epoch_us(ts) / F.lit(w)).cast("bigint") * F.lit(w))


def bucket_index(ts, width_s: int) -> Column:
    return F.floor(epoch_us(ts) / F.lit(int(width_s) * 1_000_000)).cast("bigint")


def whole_seconds_between(a, b) -> Column:
    """Whole seconds from ``a`` to ``b`` (truncated toward zero)."""
    return F.timestamp_diff("SECOND", _c(a), _c(b))


def minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def to_ntz_literal(value) -> Column:
    """Accept 'yyyy-MM-dd HH:mm[:ss]', datetime, or epoch seconds."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (int, float)):
        return from_epoch_us(F.lit(int(round(value * 1_000_000))))
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.expr(f"TIMESTAMP_NTZ'{value}'")


def resolve_range(start=None, end=None, preset: str | None = None, now=None):
    """Time-range defaults: end = now, start = end - preset (default 30 min).

    Returns a pair of Columns (start, end) for a half-open predicate.
    ``now`` may be a Column (e.g. a scalar subquery result) or a literal.
    """
    if end is None:
        end_c = to_ntz_literal(now) if now is not None else F.expr("localtimestamp()")
    else:
        end_c = to_ntz_literal(end)
    if start is None:
        secs = RANGE_PRESETS[preset] if preset else DEFAULT_RANGE_S
        start_c = add_seconds(end_c, -secs)
    else:
        start_c = to_ntz_literal(start)
    return start_c, end_c


def add_seconds(col, secs) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(int(secs * 1_000_000)), _c(col))


def to_instant(col) -> Column:
    """TIMESTAMP_NTZ (wall clock in UTC) -> TIMESTAMP instant, for event-time
    watermarks; independent of the session time zone."""
    return F.timestamp_micros(epoch_us(col))


def from_instant(col) -> Column:
    """TIMESTAMP instant -> TIMESTAMP_NTZ wall clock in UTC."""
    return from_epoch_us(F.unix_micros(_c(col)))
