"""Small fixtures: series of candles with known holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wickstore.functions.candles import repaired_high, repaired_low
from wickstore.schema import CANDLE_RECORD, HOUR_MS, KEY, KEY_FIELDS, TS

DAY_1 = 1704067200000  # 2024-01-01 00:00 UTC
SCHEMA = StructType([*KEY_FIELDS, *CANDLE_RECORD.schema.fields])


def candle(ts: int, coin: str = "BTC_USD", value: float = 100.0, interval: str = "1h") -> tuple:
    return ("ohlcv", "binance", coin, interval, ts, value, value + 5, value - 5, value + 1, 10.0)


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def hours(first: int, count: int, coin: str = "BTC_USD", skip: tuple = ()) -> list[tuple]:
    """Hourly candles from ``first``, leaving out the hour numbers in ``skip``."""
    return [
        candle(first + n * HOUR_MS, coin, 100.0 + n) for n in range(count) if n not in skip
    ]


def synthetic(spark: SparkSession, first: int, periods: int, step: int, seed: int) -> DataFrame:
    """A full grid of random candles whose high and low are repaired around open and close."""
    raw = spark.range(periods).select(
        *[F.lit(cell).alias(name) for name, cell in zip(KEY, candle(0)[:4])],
        (F.lit(first) + F.col("id") * step).alias(TS),
        (F.rand(seed) * 100 + 50_000).alias("open"),
        (F.rand(seed + 1) * 10 + 50_100).alias("high"),
        (F.rand(seed + 2) * 10 + 49_900).alias("low"),
        (F.rand(seed + 3) * 100 + 50_000).alias("close"),
        (F.rand(seed + 4) * 10 + 100).alias("volume"),
        F.col("id").alias("value"),
    )
    return raw.withColumns({"high": repaired_high(), "low": repaired_low()})


def stamps(df: DataFrame, column: str = TS) -> list[int]:
    return sorted(row[column] for row in df.select(column).collect())


def as_tuples(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(row) for row in df.select(*(columns or (*KEY, TS))).collect())
