"""Landed exchange pages: plan of the pages to fetch, and their candles as rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    FractionalType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from wickstore.functions.candles import unpack
from wickstore.functions.epoch import floor_div, interval_ms
from wickstore.functions.keys import normalised
from wickstore.operators.filters import clip, split_valid, validate
from wickstore.schema import CANDLE_RECORD, KEY, KEY_FIELDS, TS, VALUES

# Fixed value: candles an exchange returns per request unless told otherwise.
PAGE_LIMIT = 1_000

# Values stay text until they are validated, so a bad one is reported instead of lost.
PAGE_SCHEMA = StructType([*KEY_FIELDS, StructField("candles", ArrayType(ArrayType(StringType())))])


def read_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Pages as they landed: a series key and an array of positional candles.

    A line of JSON that cannot be read becomes a page of nulls, which is rejected later instead of
    lost. Other formats keep the array type of their files.
    """
    if fmt == "json":
        return spark.read.schema(PAGE_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return spark.read.format(fmt).load(path)


def raw_candles(pages: DataFrame) -> DataFrame:
    """One row per candle, values as they came, keys normalised.

    A page without an array and a candle of more than six values give a row without values, which
    validation rejects; a shorter candle lacks its last values. An empty page has no candles and gives no row.
    """
    exploded = normalised(pages.filter("candles is null or size(candles) > 0")).select(
        *KEY, F.explode_outer("candles").alias("candle")
    )
    whole = F.size("candle") <= len(VALUES) + 1
    exploded = exploded.withColumn("candle", F.when(whole, F.col("candle")))
    rows = exploded.select(*KEY, *unpack(F.col("candle")))
    if isinstance(rows.schema[TS].dataType, FractionalType):
        # A page of doubles carries whole milliseconds as doubles.
        whole = F.col(TS).cast("bigint")
        rows = rows.withColumn(TS, F.when(whole.cast("double") == F.col(TS), whole))
    return rows


def candles_from_pages(
    pages: DataFrame,
    start: int | dt.datetime | None = None,
    end: int | dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Valid candles (clipped to ``start <= timestamp < end`` if both are given) and rejects."""
    valid, rejected = split_valid(raw_candles(pages), CANDLE_RECORD)
    if start is not None and end is not None:
        valid = clip(valid, start, end)
    return valid.select(*KEY, TS, *VALUES), rejected


def checked_candles(pages: DataFrame) -> DataFrame:
    """All candles with their ``reject_reason``."""
    return validate(raw_candles(pages), CANDLE_RECORD)


def _step() -> Column:
    unknown = F.concat(F.lit("unknown interval: "), F.coalesce("interval", F.lit("null")))
    return F.coalesce(interval_ms(F.col("interval")), F.raise_error(unknown).cast("bigint"))


def page_plan(requests: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """The pages that cover ``start <= timestamp < end`` of each request.

    ``requests`` holds the series key, ``start`` and ``end`` in milliseconds. Empty ranges plan no
    page; an interval that has no length is an error.
    """
    span = _step() * F.lit(limit).cast(LongType())
    planned = (
        requests.withColumn("_span", span)
        .filter((F.col("_span") > 0) & (F.col("start") < F.col("end")))
        .select(
            "*",
            F.posexplode(F.sequence(F.col("start"), F.col("end") - 1, F.col("_span"))).alias(
                "page", "page_start"
            ),
        )
    )
    return planned.select(
        *KEY,
        F.col("page").cast("bigint").alias("page"),
        "page_start",
        F.least(F.col("page_start") + F.col("_span"), F.col("end")).alias("page_end"),
    )


def answered_spans(answers: DataFrame) -> DataFrame:
    """``since`` and ``until`` of each landed answer: it tells what the exchange has up to its last candle.

    ``answers`` holds the series key, ``since`` (the time that was asked for) and the ``candles`` that came. One
    without a candle at or after ``since`` made no progress and spans nothing. Equal spans come once.
    """
    stamp = F.transform("candles", lambda candle: F.get(candle, 0).try_cast("double").cast("bigint"))
    last = F.array_max(F.filter(stamp, lambda at: at >= F.col("since")))
    spans = normalised(answers).withColumn("_last", last)
    until = F.coalesce(F.col("_last") + _step(), F.col("since"))
    return spans.select(*KEY, "since", until.alias("until")).distinct()


def pages_to_fetch(plan: DataFrame, answers: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """The parts ``fetch_start <= timestamp < fetch_end`` of planned pages that no landed answer covers.

    ``plan`` comes from ``page_plan``; ``answers`` as in ``answered_spans``. ``reason`` says why a part is open:
    its page is ``absent`` (nothing was landed for it), ``empty`` (only answers without candles) or ``short``
    (answers ended before the page did, or left a hole). Times between two candles of one answer are covered: the
    exchange has none there.

    Spans and pages meet by series and time bucket, and the sweep that merges spans runs inside one page, so a
    long series is many small pieces.
    """
    span = _step() * F.lit(limit).cast(LongType())
    page = [*KEY, "page", "page_start", "page_end"]

    def bucketed(df: DataFrame, start: str, last: Column) -> DataFrame:
        buckets = F.sequence(floor_div(F.col(start), span), floor_div(last, span))
        return df.withColumn("_bucket", F.explode(buckets))

    planned = normalised(plan.select(*page)).distinct()
    spans = answered_spans(answers)
    met = bucketed(planned, "page_start", F.col("page_end") - 1).join(
        bucketed(spans, "since", F.greatest(F.col("since"), F.col("until") - 1)),
        [*KEY, "_bucket"],
    )
    inside = (F.col("since") < F.col("page_end")) & (
        (F.col("until") > F.col("page_start")) | (F.col("since") >= F.col("page_start"))
    )
    pieces = met.filter(inside).select(
        *page,
        F.greatest("since", "page_start").alias("start"),
        F.least("until", "page_end").alias("end"),
    )
    # Every page ends in a mark, behind which nothing is wanted.
    marks = planned.select(*page, F.col("page_end").alias("start"), F.lit(None).cast("bigint").alias("end"))
    own = Window.partitionBy(*page)
    earlier = own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covers = F.col("end") > F.col("start")
    reached = F.greatest(F.max(F.when(covers, F.col("end"))).over(earlier), F.col("page_start"))
    reason = F.when(F.max(covers).over(own), "short").when(F.count("end").over(own) > 0, "empty")
    swept = pieces.distinct().unionByName(marks).withColumns(
        {"fetch_start": reached, "fetch_end": F.col("start"), "reason": F.coalesce(reason, F.lit("absent"))}
    )
    # Parts end where a span begins or the page ends; an answer without candles says why, no more.
    swept = swept.filter((F.col("end").isNull() | covers) & (F.col("fetch_start") < F.col("fetch_end")))
    return swept.select(*page, "fetch_start", "fetch_end", "reason")
