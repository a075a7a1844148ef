"""Candles from ticks: what an exchange does before it answers a candle request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.functions.epoch import interval_to_ms
from wickstore.operators.reduce import wide_key
from wickstore.schema import KEY, TS, VALUES


def exact(size: str) -> Column:
    """A size as a decimal with 18 places, so that sums are exact and the same for every split of the data."""
    return F.col(size).cast("decimal(38,18)")


def partial_candles(
    ticks: DataFrame,
    interval: str,
    price: str = "price",
    size: str = "size",
    micros: str = "micros",
    tick_id: str | None = "tick_id",
    keys: Sequence[str] = ("data_type", "exchange", "coin"),
) -> DataFrame:
    """Candles that can still be merged: with the order keys of open and close, and the exact volume."""
    micros_step = interval_to_ms(interval) * 1000
    start = F.call_function(
        "div", F.col(micros) - F.pmod(F.col(micros), F.lit(micros_step)), F.lit(1000)
    )
    order = F.col(micros) if tick_id is None else wide_key(F.col(micros), F.col(tick_id))
    return (
        ticks.select(*keys, start.alias(TS), order.alias("_order"), price, size)
        .groupBy(*keys, TS)
        .agg(
            F.min("_order").alias("_first"),
            F.max("_order").alias("_last"),
            F.min_by(price, "_order").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "_order").alias("close"),
            F.sum(exact(size)).alias("volume"),
        )
    )


def combined_partials(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One partial candle per series and time from several sets of them."""
    return partials.groupBy(*keys, TS).agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.min_by("open", "_first").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_last").alias("close"),
        F.sum("volume").cast("decimal(38,18)").alias("volume"),
    )


def finished_candles(partials: DataFrame, interval: str) -> DataFrame:
    """Candles of partial candles of which there is one per series and time."""
    return (
        partials.withColumn("interval", F.lit(interval))
        .withColumn("volume", F.col("volume").cast("double"))
        .select(*KEY, TS, *VALUES)
    )


def candles_from_ticks(
    ticks: DataFrame,
    interval: str,
    price: str = "price",
    size: str = "size",
    micros: str = "micros",
    tick_id: str | None = "tick_id",
    keys: Sequence[str] = ("data_type", "exchange", "coin"),
) -> DataFrame:
    """One candle per series and ``interval``.

    ``ticks`` has the ``keys``, an epoch-microsecond time, a whole-number id that orders ticks of
    the same instant, a price and a size. ``tick_id=None`` says that instants never repeat within
    a series. Sizes are added exactly, to 18 places. One shuffle, of partial candles only.
    """
    return finished_candles(partial_candles(ticks, interval, price, size, micros, tick_id, keys), interval)
