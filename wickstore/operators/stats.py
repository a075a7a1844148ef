"""Counts, time coverage and distinct values per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.schema import KEY, TS


def row_counts(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def coverage(df: DataFrame, keys: Sequence[str] = KEY, ts: str = TS) -> DataFrame:
    """First and last timestamp and number of rows per series."""
    return df.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(ts).alias("n_rows")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def count_tolerance(
    df: DataFrame,
    span_ms: int | Column,
    step: int,
    tolerance: float = 0.1,
    keys: Sequence[str] = KEY,
    series: DataFrame | None = None,
) -> DataFrame:
    """Rows per series against ``span / step``, flagged when off by more than ``tolerance``.

    Series of ``series`` that have no rows are reported with none.
    """
    expected = (F.lit(span_ms) if isinstance(span_ms, int) else span_ms) / F.lit(step)
    counts = row_counts(df, keys)
    if series is not None:
        counts = counts.join(series.select(*keys).distinct(), list(keys), "full").fillna(0, ["n_rows"])
    counted = counts.withColumn("n_expected", expected.cast("double"))
    off = F.abs(F.col("n_rows") - F.col("n_expected"))
    return counted.withColumn("within", off <= F.col("n_expected") * tolerance)
