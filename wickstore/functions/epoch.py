"""Epoch milliseconds, UTC timestamps, date parts and interval lengths."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickstore.schema import DAY_MS, HOUR_MS, MINUTE_MS

# Interval lengths in milliseconds; a month is 30 days and a year 365 days.
UNIT_MS = {
    "m": MINUTE_MS,
    "h": HOUR_MS,
    "d": DAY_MS,
    "w": 7 * DAY_MS,
    "mo": 30 * DAY_MS,
    "y": 365 * DAY_MS,
}
CLIENT_UNITS = ("m", "h", "d", "w")
CLIENT_FALLBACK_MS = 5 * MINUTE_MS
SERVICE_INTERVALS = {
    "1m": MINUTE_MS,
    "5m": 5 * MINUTE_MS,
    "1h": HOUR_MS,
    "1d": DAY_MS,
    "1mo": 30 * DAY_MS,
    "1y": 365 * DAY_MS,
}
# Fixed value: smaller epoch bounds are taken as seconds.
SECONDS_BELOW = 1_000_000_000_000


def ms_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def timestamp_to_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def strip_zone(ts: Column) -> Column:
    """UTC wall clock without a zone; the session time zone is UTC."""
    return ts.cast("timestamp_ntz")


def utc_date(ms: Column) -> Column:
    """UTC date of an epoch millisecond value, whatever the session time zone is."""
    return F.date_from_unix_date(floor_div(ms, DAY_MS).cast("int"))


def date_parts(ms: Column) -> dict[str, Column]:
    date = utc_date(ms)
    return {"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)}


def normalise_epoch(value: Column) -> Column:
    """Caller-supplied bounds: seconds become milliseconds. Never for stored data."""
    value = value.cast("bigint")
    return F.when(value < SECONDS_BELOW, value * 1000).otherwise(value)


def to_ms(value: int | dt.datetime | None, seconds_allowed: bool = False) -> int | None:
    """A bound given on the driver as epoch milliseconds. Naive datetimes are UTC."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(
            milliseconds=1
        )
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"expected epoch milliseconds or datetime, got {type(value).__name__}")
    if seconds_allowed and value < SECONDS_BELOW:
        return value * 1000
    return value


def _parse(interval: Column, units: tuple[str, ...]) -> Column:
    pattern = f"^([0-9]+)({'|'.join(sorted(units, key=len, reverse=True))})$"
    count = F.nullif(F.regexp_extract(interval, pattern, 1), F.lit("")).try_cast("bigint")
    unit = F.regexp_extract(interval, pattern, 2)
    length = F.lit(None).cast("bigint")
    for name in units:
        length = F.when(unit == name, F.lit(UNIT_MS[name]).cast("bigint")).otherwise(length)
    return F.when(count > 0, F.try_multiply(count, length))


def interval_ms(interval: Column) -> Column:
    """Length of ``<n>m|h|d|w|mo|y`` in milliseconds; null when unknown."""
    return _parse(interval, tuple(UNIT_MS))


def client_interval_ms(interval: Column) -> Column:
    """The exchange-side reading: ``<n>m|h|d|w``, anything else counts as five minutes."""
    return F.coalesce(
        _parse(interval, CLIENT_UNITS), F.lit(CLIENT_FALLBACK_MS).cast("bigint")
    )


def service_interval_ms(interval: Column) -> Column:
    """The service-side reading: six fixed names; null when unknown."""
    length = F.lit(None).cast("bigint")
    for name, ms in SERVICE_INTERVALS.items():
        length = F.when(interval == name, F.lit(ms).cast("bigint")).otherwise(length)
    return length


def interval_to_ms(interval: str) -> int:
    """``interval_ms`` for one value on the driver; unknown is an error."""
    match = re.fullmatch(r"([0-9]+)(mo|m|h|d|w|y)", interval)
    length = int(match.group(1)) * UNIT_MS[match.group(2)] if match else 0
    if not 0 < length < 2**63:
        raise ValueError(f"invalid interval: {interval!r}")
    return length


def floor_ms(ms: Column, step: int | Column) -> Column:
    """``ms`` rounded down to a multiple of ``step``; exact for negative values too."""
    return ms - F.pmod(ms, F.lit(step) if isinstance(step, int) else step)


def floor_div(value: Column, step: int) -> Column:
    """Whole-number division rounding down, in long arithmetic."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))
