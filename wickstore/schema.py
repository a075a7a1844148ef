"""Series keys, record types and partition layouts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

KEY = ("data_type", "exchange", "coin", "interval")
PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")
TS = "timestamp"
INGEST = "ingest_id"

# Steps in milliseconds.
SECOND_MS = 1_000
MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

KEY_FIELDS = [StructField(name, StringType(), False) for name in KEY]


@dataclass(frozen=True)
class RecordType:
    """What a record of one data type must carry. ``schema`` excludes the series key."""

    name: str
    schema: StructType
    required: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


BASE_RECORD = RecordType("base", StructType([StructField(TS, LongType(), False)]), (TS,))

CANDLE_RECORD = RecordType(
    "ohlcv",
    StructType(
        [StructField(TS, LongType(), False)]
        + [StructField(name, DoubleType(), True) for name in VALUES]
    ),
    (TS, *VALUES),
)

_RECORD_TYPES: dict[str, RecordType] = {"ohlcv": CANDLE_RECORD}


def register_record_type(data_type: str, record: RecordType) -> None:
    _RECORD_TYPES[data_type] = record


def record_type(data_type: str | None) -> RecordType:
    """The record type registered for ``data_type``; unknown or missing is an error."""
    if not data_type:
        raise ValueError("data_type is required")
    if data_type not in _RECORD_TYPES:
        raise ValueError(f"no record type registered for data_type {data_type!r}")
    return _RECORD_TYPES[data_type]


@dataclass(frozen=True)
class SeriesKey:
    """A full or partial series key. ``None`` means any."""

    data_type: str | None = "ohlcv"
    exchange: str | None = None
    coin: str | None = None
    interval: str | None = None

    def given(self) -> dict[str, str]:
        """The parts that are set, normalised as they are stored."""
        from wickstore.functions.keys import normalise_part

        return {
            name: normalise_part(name, value)
            for name in KEY
            if (value := getattr(self, name)) is not None
        }


class PartitionLayout(NamedTuple):
    """Date columns that follow the series key in the directory layout."""

    name: str
    columns: tuple[str, ...]


YEAR_MONTH_DAY = PartitionLayout("year_month_day", ("year", "month", "day"))
YEAR_MONTH = PartitionLayout("year_month", ("year", "month"))
NO_DATE = PartitionLayout("none", ())

DATE_FIELDS = {name: StructField(name, IntegerType(), True) for name in ("year", "month", "day")}
