"""Filters on time, key, arbitrary conditions and membership; record validation."""

from __future__ import annotations

import datetime as dt
import functools
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    FractionalType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from wickstore.functions.candles import to_epoch, to_number
from wickstore.functions.epoch import floor_div, to_ms
from wickstore.functions.keys import comparable
from wickstore.schema import DAY_MS, TS, RecordType

logger = logging.getLogger(__name__)

Condition = tuple[str, str, object]
_INSTANTS = (TimestampType, TimestampNTZType)


def resolve_ts_column(df: DataFrame, name: str | None = None) -> str | None:
    """The named column if present, else the first timestamp-typed one, else ``timestamp``."""
    if name and name in df.columns:
        return name
    for field in df.schema.fields:
        if isinstance(field.dataType, _INSTANTS):
            return field.name
    return TS if TS in df.columns else None


def _instant(df: DataFrame, name: str, ms: int) -> Column:
    if isinstance(df.schema[name].dataType, _INSTANTS):
        return F.timestamp_millis(F.lit(ms)).cast(df.schema[name].dataType)
    return F.lit(ms)


def time_between(
    df: DataFrame,
    start: int | dt.datetime | None = None,
    end: int | dt.datetime | None = None,
    ts: str | None = None,
) -> DataFrame:
    """Closed range ``start <= ts <= end``; a ``None`` bound is open.

    Without any time column the frame comes back unfiltered, with a warning.
    """
    name = resolve_ts_column(df, ts)
    if name is None:
        logger.warning("no time column in %s; time range not applied", df.columns)
        return df
    lo, hi = to_ms(start), to_ms(end)
    if lo is not None:
        df = df.filter(F.col(name) >= _instant(df, name, lo))
    if hi is not None:
        df = df.filter(F.col(name) <= _instant(df, name, hi))
    return df


def clip(df: DataFrame, start: int | dt.datetime, end: int | dt.datetime, ts: str = TS):
    """Half-open range ``start <= ts < end`` of a fetch. Bounds in seconds are accepted."""
    lo, hi = to_ms(start, seconds_allowed=True), to_ms(end, seconds_allowed=True)
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def lookback(df: DataFrame, as_of: int | dt.datetime, span_ms: int = DAY_MS, ts: str = TS):
    """The last ``span_ms`` up to and including ``as_of``."""
    now = to_ms(as_of)
    return time_between(df, now - span_ms, now, ts)


def _condition(col: Column, op: str, value: object) -> Column:
    if op in ("=", "=="):
        return col == value
    if op == "!=":
        return col != value
    if op == "<":
        return col < value
    if op == "<=":
        return col <= value
    if op == ">":
        return col > value
    if op == ">=":
        return col >= value
    if op == "in":
        return col.isin(list(value))
    if op == "not in":
        return ~col.isin(list(value))
    raise ValueError(f"unknown operator: {op!r}")


def conditions_to_column(
    conditions: Sequence[Condition], renames: Mapping[str, Column] | None = None
) -> Column:
    """Fold ``(column, operator, value)`` tuples into one conjunction."""
    renames = renames or {}
    terms = [
        _condition(renames.get(name, F.col(name)), op, value) for name, op, value in conditions
    ]
    return functools.reduce(lambda a, b: a & b, terms, F.lit(True))


def where_all(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    return df.filter(conditions_to_column(conditions))


def with_availability(
    df: DataFrame, markets: DataFrame, keys: Sequence[str] = ("exchange", "coin")
) -> DataFrame:
    """Adds ``is_available``: whether the symbol is in the exchange's market list."""
    listed = markets.select(*[comparable(k, F.col(k)).alias(f"_m_{k}") for k in keys]).distinct()
    listed = listed.withColumn("_listed", F.lit(True))
    same = [comparable(k, F.col(k)) == F.col(f"_m_{k}") for k in keys]
    joined = df.join(listed, functools.reduce(lambda a, b: a & b, same), "left")
    return joined.select(*df.columns, F.coalesce("_listed", F.lit(False)).alias("is_available"))


def split_by_membership(
    df: DataFrame, members: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``keys`` are in ``members``, and the rest."""
    wanted = members.select(*keys)
    return df.join(wanted, list(keys), "left_semi"), df.join(wanted, list(keys), "left_anti")


def remove_windows(
    df: DataFrame,
    windows: DataFrame,
    keys: Sequence[str] = (),
    ts: str = TS,
    bucket_ms: int = DAY_MS,
) -> DataFrame:
    """Drop rows inside any ``[start, end)`` of ``windows`` (per ``keys`` if given).

    Windows are cut at bucket borders so the range test becomes an equality join on the bucket,
    which Spark can shuffle and split; without it the whole window list would be broadcast.
    """
    first = floor_div(F.col("start"), bucket_ms)
    last = floor_div(F.col("end") - 1, bucket_ms)
    cut = (
        windows.filter(F.col("start") < F.col("end"))
        .select(*keys, "start", "end", F.explode(F.sequence(first, last)).alias("_bucket"))
        .select(
            *[comparable(name, F.col(name)).alias(f"_w_{name}") for name in keys],
            *[F.col(name).alias(f"_w_{name}") for name in ("start", "end", "_bucket")],
        )
    )
    rows = df.withColumn("_bucket", floor_div(F.col(ts), bucket_ms))
    match = [comparable(name, F.col(name)) == F.col(f"_w_{name}") for name in (*keys, "_bucket")]
    inside = (F.col(ts) >= F.col("_w_start")) & (F.col(ts) < F.col("_w_end"))
    on = functools.reduce(lambda a, b: a & b, [*match, inside])
    return rows.join(cut, on, "left_anti").drop("_bucket")


def _problem(name: str, wanted, actual) -> tuple[Column, Column]:
    """Value of the wanted type, and whether a present value failed to become one."""
    col = F.col(name)
    if isinstance(actual, BooleanType) or (
        isinstance(wanted, IntegralType) and isinstance(actual, FractionalType)
    ):
        return F.lit(None).cast(wanted), col.isNotNull()
    if isinstance(actual, StringType) and isinstance(wanted, NumericType):
        value = to_epoch(col) if isinstance(wanted, IntegralType) else to_number(col)
    else:
        value = col.try_cast(wanted)
    return value, col.isNotNull() & value.isNull()


def validate(df: DataFrame, record: RecordType) -> DataFrame:
    """Typed columns plus ``reject_reason`` (null for a valid row).

    A required column that is null or absent is ``missing``; a value of the wrong kind is
    ``type``. Fractional or boolean timestamps and boolean prices are of the wrong kind. Columns
    outside the record type pass through.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    values, missing, wrong = {}, [], []
    for field in record.schema.fields:
        name = field.name
        if name not in types:
            values[name] = F.lit(None).cast(field.dataType)
            if name in record.required:
                missing.append(F.lit(name))
            continue
        value, bad = _problem(name, field.dataType, types[name])
        values[name] = value
        wrong.append(F.when(bad, F.lit(name)))
        if name in record.required:
            missing.append(F.when(F.col(name).isNull(), F.lit(name)))
    absent = F.concat_ws(",", *missing)
    mistyped = F.concat_ws(",", *wrong)
    reason = F.when(absent != "", F.concat(F.lit("missing: "), absent)).when(
        mistyped != "", F.concat(F.lit("type: "), mistyped)
    )
    extras = [name for name in df.columns if name not in record.columns]
    return df.select(
        *extras,
        *[values[name].alias(name) for name in record.columns],
        reason.alias("reject_reason"),
    )


def split_valid(df: DataFrame, record: RecordType) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, record)
    valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, checked.filter(F.col("reject_reason").isNotNull())
