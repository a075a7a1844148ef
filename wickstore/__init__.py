"""wickstore: store and query OHLCV candles of many series with Spark DataFrames."""

from wickstore.schema import (
    KEY,
    NO_DATE,
    YEAR_MONTH,
    YEAR_MONTH_DAY,
    RecordType,
    SeriesKey,
    record_type,
    register_record_type,
)
from wickstore.session import build_session
from wickstore.sources.store import CandleStore

__all__ = [
    "KEY",
    "NO_DATE",
    "YEAR_MONTH",
    "YEAR_MONTH_DAY",
    "CandleStore",
    "RecordType",
    "SeriesKey",
    "build_session",
    "record_type",
    "register_record_type",
]
