"""Frames the queries share, all derived from the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickstore.functions.epoch import floor_ms
from wickstore.schema import DAY_MS, KEY, TS, VALUES
from wickstore.sources.ticks import candles_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("ohlcv").alias("data_type"),
        F.lit("synthetic").alias("exchange"),
        F.upper("event_type").alias("coin"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("price"),
        F.col("value").alias("size"),
    )


def candles(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return candles_from_ticks(event_ticks(table(spark, sf_dir, "events")), interval)


def order_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of order prices, one series per priority."""
    ticks = table(spark, sf_dir, "orders").select(
        F.lit("ohlcv").alias("data_type"),
        F.lit("synthetic").alias("exchange"),
        F.upper("o_orderpriority").alias("coin"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("micros"),
        F.col("o_orderkey").alias("tick_id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_totalprice").alias("size"),
    )
    return candles_from_ticks(ticks, "1d")


def raw_pages(candle_rows: DataFrame) -> DataFrame:
    """Candles regrouped into one positional page per series and day."""
    fields = F.array(F.col(TS).cast("double"), *[F.col(name) for name in VALUES])
    return (
        candle_rows.groupBy(*KEY, floor_ms(F.col(TS), DAY_MS).alias("page_day"))
        .agg(F.array_sort(F.collect_list(fields)).alias("candles"))
    )


def markets(candle_rows: DataFrame) -> DataFrame:
    """Coins the exchange lists: all but the alphabetically last one."""
    coins = candle_rows.select("exchange", "coin").distinct()
    last = coins.groupBy("exchange").agg(F.max("coin").alias("coin"))
    return coins.join(last, ["exchange", "coin"], "left_anti")


def requested(candle_rows: DataFrame) -> DataFrame:
    """Every stored series plus, per exchange, one that is not stored."""
    known = candle_rows.select(*KEY).distinct()
    unknown = known.withColumn("coin", F.lit("UNKNOWN")).distinct()
    return known.unionByName(unknown)


def last_timestamp(candle_rows: DataFrame) -> DataFrame:
    return candle_rows.agg(F.max(TS).alias("as_of"))
