"""The newest row of every series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from wickstore.operators.filters import lookback
from wickstore.operators.reduce import top_row
from wickstore.schema import DAY_MS, KEY, TS


def latest(
    df: DataFrame, keys: Sequence[str] = KEY, ts: str = TS, tie: str | None = None
) -> DataFrame:
    """The row with the greatest timestamp per ``keys``; ``tie`` decides between equal ones."""
    return top_row(df, keys, [ts] if tie is None else [ts, tie])


def latest_within(
    df: DataFrame,
    as_of: int | dt.datetime,
    span_ms: int = DAY_MS,
    keys: Sequence[str] = KEY,
    ts: str = TS,
) -> DataFrame:
    """As ``latest``, seeing only the last ``span_ms`` before ``as_of``."""
    return latest(lookback(df, as_of, span_ms, ts), keys, ts)


def latest_wins(
    df: DataFrame, ingest: str, keys: Sequence[str] = KEY, ts: str = TS
) -> DataFrame:
    """One row per series and timestamp: the one with the greatest ``ingest`` value."""
    return top_row(df, [*keys, ts], [ingest])
