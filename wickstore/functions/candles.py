"""Candle rows: positional arrays to columns, casts, repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickstore.schema import TS, VALUES


_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def unpack(candle: Column) -> list[Column]:
    """``[timestamp, open, high, low, close, volume]`` as raw named columns."""
    return [F.get(candle, i).alias(name) for i, name in enumerate((TS, *VALUES))]


def to_epoch(raw: Column) -> Column:
    """A whole number of milliseconds, or null. Fractions and text are not timestamps."""
    return raw.try_cast("bigint")


def to_number(raw: Column) -> Column:
    """A double, or null when the value is not a number.

    Text must be a plain decimal number; type suffixes such as ``1d``, the words for infinity and
    numbers beyond the range of a double are not. A NaN that came as a double stays one.
    """
    number = raw.try_cast("double")
    plain = raw.cast("string").rlike(_DECIMAL) | F.isnan(number)
    return F.when(plain & (F.abs(number) != float("inf")), number)


def _number(name: str) -> Column:
    """A price with NaN read as absent."""
    return F.when(~F.isnan(name), F.col(name))


def repaired_high() -> Column:
    return F.greatest(_number("open"), _number("high"), _number("close"))


def repaired_low() -> Column:
    return F.least(_number("open"), _number("low"), _number("close"))
