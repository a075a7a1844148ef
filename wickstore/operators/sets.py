"""Combining and comparing batches."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    FractionalType,
    IntegralType,
    LongType,
    NullType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from wickstore.functions.epoch import floor_div, timestamp_to_ms
from wickstore.schema import DAY_MS, KEY, TS
from wickstore.session import cut_lineage


def _widest(types: list):
    """Null gives way to anything, whole numbers to fractions, and any other mix is text.

    Decimals among whole numbers and decimals stay decimals, as wide as all of them need.
    """
    kinds = [kind for kind in types if not isinstance(kind, NullType)]
    if not kinds:
        return StringType()
    if all(kind == kinds[0] for kind in kinds):
        return kinds[0]
    if all(isinstance(kind, (DecimalType, IntegralType)) for kind in kinds):
        if all(isinstance(kind, IntegralType) for kind in kinds):
            return LongType()
        scale = max(kind.scale for kind in kinds if isinstance(kind, DecimalType))
        whole = max(kind.precision - kind.scale if isinstance(kind, DecimalType) else 19 for kind in kinds)
        return DecimalType(min(38, whole + scale), min(scale, 38 - min(whole, 38)))
    if all(isinstance(kind, (FractionalType, IntegralType)) for kind in kinds):
        return DoubleType()
    return StringType()


def _one_time_unit(batches: Sequence[DataFrame]) -> list[DataFrame]:
    kinds = [batch.schema[TS].dataType for batch in batches if TS in batch.columns]
    if not any(isinstance(kind, IntegralType) for kind in kinds):
        return list(batches)
    return [
        batch.withColumn(TS, timestamp_to_ms(F.col(TS)))
        if TS in batch.columns and isinstance(batch.schema[TS].dataType, (TimestampType, TimestampNTZType))
        else batch
        for batch in batches
    ]


def union_batches(*batches: DataFrame) -> DataFrame:
    """All rows of all batches; a column missing from a batch is null in its rows.

    A ``timestamp`` that is an instant in some batches and whole milliseconds in others becomes
    milliseconds in all.
    """
    batches = _one_time_unit(batches)
    seen: dict[str, list] = {}
    for batch in batches:
        for field in batch.schema.fields:
            seen.setdefault(field.name, []).append(field.dataType)
    types = {name: _widest(kinds) for name, kinds in seen.items()}
    aligned = [
        batch.select(*[batch[name].cast(types[name]).alias(name) for name in batch.columns])
        for batch in batches
    ]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def differences(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in ``a`` and rows only in ``b``, counting copies."""
    columns = a.columns
    return a.exceptAll(b.select(*columns)), b.select(*columns).exceptAll(a)


def _day_digests(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str) -> DataFrame:
    """Rows per series and day, and two sums of row digests that do not depend on the order of rows.

    Copies add up, so a row that is there twice differs from one that is there once. Sums are decimals, which
    digests of any number of rows fit into.
    """
    cells = [F.col(name) for name in columns]
    first = F.xxhash64(*cells).cast("decimal(20,0)")
    second = F.xxhash64(F.lit(1), *cells).cast("decimal(20,0)")
    return df.groupBy(*keys, floor_div(F.col(ts), DAY_MS).alias("_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(first).alias("first"), F.sum(second).alias("second")
    )


def verify(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY, ts: str = TS) -> DataFrame:
    """Rows that are in one of two frames only: ``side`` ``a`` or ``b``, and how many ``copies`` more it has.

    Both sides are summed to one digest per series and day first; only rows of days whose digests or counts
    differ are compared, so two equal frames of any size cost one aggregation each.
    """
    columns = a.columns
    sides = {"a": a, "b": b.select(*columns)}
    digests = {side: _day_digests(df, columns, keys, ts) for side, df in sides.items()}
    group = [*keys, "_day"]
    sums = [*group, "n", "first", "second"]
    tagged = digests["a"].select(*sums).withColumn("_of", F.lit(1)).unionByName(
        digests["b"].select(*sums).withColumn("_of", F.lit(-1))
    )
    # A day that both sides agree on has the same row twice.
    differ = cut_lineage(
        tagged.groupBy(*sums).agg(F.sum("_of").alias("_net")).filter("_net <> 0").select(*group).distinct()
    )
    differ = differ.select(*[F.col(name).alias(f"_d{n}") for n, name in enumerate(group)])

    def suspects(side: str, weight: int) -> DataFrame:
        rows = sides[side].withColumn("_day", floor_div(F.col(ts), DAY_MS))
        same = [F.col(name).eqNullSafe(F.col(f"_d{n}")) for n, name in enumerate(group)]
        found = rows.join(differ, functools.reduce(lambda x, y: x & y, same), "left_semi")
        return found.select(*columns, F.lit(weight).alias("_of"))

    net = suspects("a", 1).unionByName(suspects("b", -1)).groupBy(*columns).agg(F.sum("_of").alias("_net"))
    return net.filter("_net <> 0").select(
        *columns,
        F.when(F.col("_net") > 0, "a").otherwise("b").alias("side"),
        F.abs("_net").alias("copies"),
    )
