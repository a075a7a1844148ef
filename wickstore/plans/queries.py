"""The query catalog: every operator as a callable ``(spark, sf_dir) -> DataFrame``.

All queries run over whole tables of the data folder. Store queries write to a new folder under
the shared scratch root and return what they read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickstore.functions import candles as candle_functions
from wickstore.functions import epoch, keys
from wickstore.functions.epoch import floor_ms
from wickstore.operators import filters, gaps, latest, paging, sets, stats, sync
from wickstore.operators.paging import Paging
from wickstore.plans import frames
from wickstore.schema import (
    CANDLE_RECORD,
    DAY_MS,
    HOUR_MS,
    KEY,
    MINUTE_MS,
    NO_DATE,
    TS,
    VALUES,
    YEAR_MONTH,
    SeriesKey,
)
from wickstore.session import cut_lineage, scratch_path
from wickstore.sources import infer, pages
from wickstore.sources.compaction import compact
from wickstore.sources.store import CandleStore
from wickstore.sources.ticks import candles_from_ticks
from wickstore.streaming.ingest import (
    ingest_candles,
    ingest_pages,
    read_quarantine,
    stream_candles,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Instants the range queries use, inside the span of the events table.
JAN_5, JAN_9, JAN_10, JAN_15, JAN_20 = (
    1704412800000,
    1704758400000,
    1704844800000,
    1705276800000,
    1705708800000,
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.candles(spark, sf_dir, "1h")


def _minutely(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.candles(spark, sf_dir, "1m")


def _last(rows: DataFrame) -> int:
    return rows.agg(F.max(TS)).first()[0]


# ------------------------------------------------------------------ candles and pages


@query
def candles_1h(spark, sf_dir):
    return _hourly(spark, sf_dir)


@query
def candles_1m(spark, sf_dir):
    return _minutely(spark, sf_dir)


@query
def candles_1d(spark, sf_dir):
    return frames.order_candles(spark, sf_dir)


@query
def candles_small_sizes(spark, sf_dir):
    """Sizes with eight decimals are added exactly."""
    ticks = frames.event_ticks(frames.table(spark, sf_dir, "events"))
    return candles_from_ticks(ticks.withColumn("size", F.col("size") / 1_000_000), "1h")


@query
def pages_landed(spark, sf_dir):
    """Pages written as JSON (whole milliseconds) and as Parquet (doubles) and read again."""
    doubles = frames.raw_pages(_hourly(spark, sf_dir))
    text = F.transform(
        "candles",
        lambda candle: F.transform(
            candle,
            lambda value, n: F.when(n == 0, value.cast("bigint").cast("string")).otherwise(value.cast("string")),
        ),
    )
    found = []
    for fmt, landed in (("json", doubles.withColumn("candles", text)), ("parquet", doubles)):
        path = scratch_path(spark, "pages")
        landed.write.format(fmt).save(path)
        valid, _ = pages.candles_from_pages(pages.read_pages(spark, path, fmt))
        found.append(valid)
    return sets.union_batches(*found)


@query
def raw_pages_to_candles(spark, sf_dir):
    valid, _ = pages.candles_from_pages(frames.raw_pages(_hourly(spark, sf_dir)))
    return valid


@query
def fetch_clip(spark, sf_dir):
    # Bounds in seconds, as a caller may pass them.
    return filters.clip(_minutely(spark, sf_dir), JAN_10 // 1000, JAN_20 // 1000)


@query
def fetch_page_plan(spark, sf_dir):
    spans = stats.coverage(_minutely(spark, sf_dir))
    requests = spans.select(
        *KEY, F.col("first_ts").alias("start"), (F.col("last_ts") + MINUTE_MS).alias("end")
    )
    return pages.page_plan(requests)


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The page plan of the minute candles, and what was landed for it: of each five pages one has no answer, one
    half an answer and a later one that overlaps it, one an empty answer, two all there is."""
    plan = fetch_page_plan(spark, sf_dir)
    span = pages.PAGE_LIMIT * MINUTE_MS
    rows = _minutely(spark, sf_dir).join(plan, list(KEY)).filter(
        F.col(TS).between(F.col("page_start"), F.col("page_end") - 1)
    )
    kind, into = F.col("page") % 5, F.col(TS) - F.col("page_start")
    asked = plan.filter("page % 5 <> 1").select(*KEY, "page_start", F.lit(0).alias("skip"))
    again = plan.filter("page % 5 = 2").select(*KEY, "page_start", F.lit(span * 3 // 10).alias("skip"))
    came = F.when(kind == 2, F.array(
        F.when(into < span // 2, 0), F.when(into.between(span * 3 // 10, span * 7 // 10), span * 3 // 10)
    )).when(kind.isin(0, 4), F.array(F.lit(0)))
    landed = (
        rows.withColumn("skip", F.explode(came))
        .filter("skip is not null")
        .groupBy(*KEY, "page_start", F.col("skip").cast("int").alias("skip"))
        .agg(F.collect_list(F.array(TS, *VALUES)).alias("candles"))
    )
    none = F.array().cast("array<array<double>>")
    answers = asked.unionByName(again).join(landed, [*KEY, "page_start", "skip"], "left")
    return plan, answers.select(
        *KEY, (F.col("page_start") + F.col("skip")).alias("since"), F.coalesce("candles", none).alias("candles")
    )


@query
def page_coverage(spark, sf_dir):
    plan, answers = _answers(spark, sf_dir)
    return pages.pages_to_fetch(plan, answers)


@query
def validate_split(spark, sf_dir):
    event = F.col("event_id")
    text = F.col("value").cast("string")
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    raw = frames.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(event % 13 == 0, F.concat(millis, F.lit(".5"))).otherwise(millis).alias(TS),
        F.when(event % 7 != 0, text).alias("open"),
        text.alias("high"),
        text.alias("low"),
        F.when(event % 11 == 0, F.lit("not-a-number")).otherwise(text).alias("close"),
        F.when(event % 17 == 0, F.lit("true")).otherwise(text).alias("volume"),
    )
    return filters.validate(raw, CANDLE_RECORD)


@query
def candle_casts(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(
        F.col("value").cast("string")
    )
    return frames.table(spark, sf_dir, "events").select(
        "event_id",
        candle_functions.to_number(text).alias("as_number"),
        candle_functions.to_epoch(F.col("user_id").cast("string")).alias("as_epoch"),
    )


@query
def ohlc_repair(spark, sf_dir):
    damaged = _minutely(spark, sf_dir).select(
        *KEY,
        TS,
        "open",
        F.col("low").alias("high"),
        (F.col("high") + 1).alias("low"),
        "close",
    )
    return damaged.select(
        *KEY,
        TS,
        "open",
        "close",
        candle_functions.repaired_high().alias("high"),
        candle_functions.repaired_low().alias("low"),
    )


@query
def infer_types(spark, sf_dir):
    return infer.infer_types(frames.table(spark, sf_dir, "events"), "props")


@query
def schema_union(spark, sf_dir):
    # Records of two kinds: `amount` is whole in one and a fraction in the other, `label` is text
    # in one and a flag in the other, `note` is always null.
    orders = frames.table(spark, sf_dir, "orders").select(
        F.to_json(
            F.struct(
                F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias(TS),
                F.col("o_totalprice").alias("amount"),
                F.col("o_orderstatus").alias("label"),
                F.lit(None).cast("string").alias("note"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("record")
    )
    events = frames.table(spark, sf_dir, "events").select(
        F.to_json(
            F.struct(
                F.unix_millis(F.col("ts").cast("timestamp")).alias(TS),
                F.col("user_id").alias("amount"),
                (F.col("value") > 100).alias("label"),
                (F.col("user_id") > 10).alias("flag"),
            )
        ).alias("record")
    )
    return infer.infer_types(sets.union_batches(orders, events), "record")


# ------------------------------------------------------------------- keys and time


def _customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy series keys, some with empty or absent parts."""
    customer = frames.table(spark, sf_dir, "customer")
    number = F.col("c_custkey")
    return customer.select(
        "c_custkey",
        F.lit("ohlcv").alias("data_type"),
        F.when(number % 11 != 0, F.concat(F.lit("The "), "c_mktsegment")).alias("exchange"),
        F.when(number % 7 == 0, F.lit("  "))
        .when(number % 13 != 0, F.concat(F.lit(" "), F.lower("c_name"), F.lit("/usd ")))
        .alias("coin"),
        F.when(number % 17 != 0, F.concat((number % 5).cast("string"), F.lit("H "))).alias(
            "interval"
        ),
    )


@query
def normalise_key(spark, sf_dir):
    return _customer_keys(spark, sf_dir).select(
        "c_custkey", *[keys.normalise(name, F.col(name)).alias(name) for name in KEY]
    )


@query
def encode_path(spark, sf_dir):
    parts = [F.col(name) for name in KEY]
    return _customer_keys(spark, sf_dir).select(
        "c_custkey",
        keys.encode_path(*parts).alias("path"),
        keys.key_error(*parts[1:]).alias("error"),
    )


@query
def path_prefix(spark, sf_dir):
    parts = [F.col(name) for name in KEY]
    return _customer_keys(spark, sf_dir).select(
        "c_custkey", keys.path_prefix(*parts).alias("prefix")
    )


@query
def decode_path(spark, sf_dir):
    number = F.col("c_custkey")
    path = F.concat_ws(
        "/",
        F.when(number % 3 == 0, F.lit("")),
        F.when(number % 5 == 0, F.lit("trades")).otherwise(F.lit("ohlcv")),
        F.lower("c_mktsegment"),
        F.when(number % 7 != 0, F.upper("c_name")),
        F.lit("1h"),
        F.when(number % 4 == 0, F.lit("year=2024")),
    )
    decoded = frames.table(spark, sf_dir, "customer").select(
        "c_custkey", keys.decode_path(path).alias("decoded")
    )
    return decoded.select("c_custkey", "decoded.*")


@query
def ms_roundtrip(spark, sf_dir):
    millis = epoch.timestamp_to_ms(F.col("ts").cast("timestamp"))
    return frames.table(spark, sf_dir, "events").select(
        "event_id",
        millis.alias("ms"),
        epoch.timestamp_to_ms(epoch.ms_to_timestamp(millis)).alias("ms_again"),
    )


@query
def date_parts(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    parts = epoch.date_parts(epoch.timestamp_to_ms(at))
    wall_clock = F.date_format(epoch.strip_zone(at), "yyyy-MM-dd HH:mm:ss")
    return frames.table(spark, sf_dir, "events").select(
        "event_id",
        *[part.alias(name) for name, part in parts.items()],
        wall_clock.alias("wall_clock"),
    )


@query
def epoch_normalise(spark, sf_dir):
    millis = epoch.timestamp_to_ms(F.col("ts").cast("timestamp"))
    given = F.when(F.col("event_id") % 2 == 0, millis).otherwise(
        F.call_function("div", millis, F.lit(1000))
    )
    return frames.table(spark, sf_dir, "events").select(
        "event_id", epoch.normalise_epoch(given).alias("bound")
    )


@query
def interval_ms(spark, sf_dir):
    units = ["m", "h", "d", "w", "mo", "y", "x", ""]
    unit = F.get(F.array(*[F.lit(name) for name in units]), (F.col("event_id") % 8).cast("int"))
    text = F.concat((F.col("user_id") % 7).cast("string"), unit)
    return frames.table(spark, sf_dir, "events").select(
        "event_id",
        text.alias("text"),
        epoch.interval_ms(text).alias("any_ms"),
        epoch.client_interval_ms(text).alias("client_ms"),
        epoch.service_interval_ms(text).alias("service_ms"),
    )


# ---------------------------------------------------------------- store: write and read

def _new_store(spark: SparkSession, layout=None) -> CandleStore:
    root = scratch_path(spark, "store")
    return CandleStore(spark, root) if layout is None else CandleStore(spark, root, layout)


def _store_of(spark: SparkSession, rows: DataFrame, layout=None) -> CandleStore:
    store = _new_store(spark, layout)
    store.write(rows)
    return store


def _hourly_store(spark: SparkSession, sf_dir: str) -> CandleStore:
    return _store_of(spark, _hourly(spark, sf_dir))


@query
def store_roundtrip(spark, sf_dir):
    return _store_of(spark, _hourly(spark, sf_dir)).read_range()


@query
def store_by_month(spark, sf_dir):
    store = _store_of(spark, frames.order_candles(spark, sf_dir), YEAR_MONTH)
    return store.read_range()


@query
def store_unpartitioned(spark, sf_dir):
    return _store_of(spark, _hourly(spark, sf_dir), NO_DATE).read_range()


@query
def store_overwrite_series(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, rows)
    revised = rows.filter(F.col("coin").isin("CLICK", "VIEW") & (F.col(TS) >= JAN_15))
    store.write(revised.withColumn("volume", F.col("volume") * 2), mode="overwrite")
    return store.read_range()


@query
def store_schema_merge(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, rows.filter(F.col(TS) < JAN_15))
    later = rows.filter(F.col(TS) >= JAN_15)
    store.write(later.withColumn("spread", F.col("high") - F.col("low")))
    return store.read_range()


@query
def store_skip_empty(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, rows)
    store.write(rows.filter(F.lit(False)))
    return store.read_range()


@query
def store_missing_empty(spark, sf_dir):
    absent = _new_store(spark).read_range(columns=[*KEY, TS])
    return _hourly(spark, sf_dir).join(absent, [*KEY, TS], "left_anti")


@query
def range_closed(spark, sf_dir):
    return _hourly_store(spark, sf_dir).read_range(start=JAN_5, end=JAN_9)


@query
def range_open_ended(spark, sf_dir):
    return _hourly_store(spark, sf_dir).read_range(start=JAN_20)


@query
def project_columns(spark, sf_dir):
    return _hourly_store(spark, sf_dir).read_range(columns=["coin", "close"])


@query
def filter_tuples(spark, sf_dir):
    where = [
        ("coin", "in", ["CLICK", "VIEW", "ERROR"]),
        ("coin", "!=", "ERROR"),
        ("close", ">", 20.0),
        ("volume", "<=", 400.0),
        (TS, ">=", JAN_5),
    ]
    return _hourly_store(spark, sf_dir).read_range(where=where)


@query
def series_filter(spark, sf_dir):
    key = SeriesKey(exchange="Synthetic", coin="click", interval="1H")
    return _hourly_store(spark, sf_dir).read_range(key)


@query
def resolve_ts_column(spark, sf_dir):
    events = frames.table(spark, sf_dir, "events")
    found = filters.time_between(events, JAN_5, JAN_9, ts="no_such_column")
    return found.select("event_id", "value")


@query
def latest_wins(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _new_store(spark)
    store.write(rows, ingest_id=1)
    revised = rows.filter(F.col(TS) >= JAN_15).withColumn("close", F.col("close") + 1)
    store.write(revised, ingest_id=2)
    return store.read_latest_wins()


@query
def verify_copy(spark, sf_dir):
    """A copy that lost some rows, has some twice and some changed, against its original."""
    rows = _minutely(spark, sf_dir)
    fate = F.floor(F.col(TS) / MINUTE_MS) % 997
    times = F.when(fate == 0, 0).when(fate == 1, 2).otherwise(1)
    damaged = rows.withColumn("close", F.when(fate == 2, F.col("close") + 1).otherwise(F.col("close")))
    damaged = damaged.withColumn("_n", F.explode(F.array_repeat(F.lit(1), times))).drop("_n")
    return sets.verify(rows, damaged)


def _appended(spark: SparkSession, sf_dir: str, times: int) -> CandleStore:
    """Minute candles in several appends, each with rows of every day."""
    store, rows = _new_store(spark), cut_lineage(_minutely(spark, sf_dir))
    for n in range(times):
        store.write(rows.filter(F.pmod(F.xxhash64(*KEY, TS), F.lit(times)) == n), ingest_id=n + 1)
    return store


@query
def store_compact(spark, sf_dir):
    """Files and rows of each partition after five appends were compacted."""
    store = _appended(spark, sf_dir, 5)
    compact(store)
    parts = store.partition_columns
    counted = store.scan().groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(store.file_counts().drop("n_bytes"), parts)


@query
def store_page(spark, sf_dir):
    """A page by stored counts, of rows that came in several appends."""
    return _appended(spark, sf_dir, 3).page(Paging(limit=100, offset=250))


@query
def store_last_timestamps(spark, sf_dir):
    return _appended(spark, sf_dir, 3).last_timestamps()


# ----------------------------------------------------------------------- catalog


@query
def list_coins(spark, sf_dir):
    return _hourly_store(spark, sf_dir).list_coins("Synthetic")


@query
def series_exists(spark, sf_dir):
    wanted = frames.requested(_hourly(spark, sf_dir))
    return _hourly_store(spark, sf_dir).which_exist(wanted)


@query
def store_inventory(spark, sf_dir):
    return _hourly_store(spark, sf_dir).inventory()


@query
def drop_series(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, rows)
    wanted = frames.requested(rows)
    store.drop_series(wanted.filter(F.col("coin").isin("VIEW", "UNKNOWN")))
    return store.read_range()


# ------------------------------------------------------------- latest, counts, coverage


@query
def latest_lookback(spark, sf_dir):
    rows = _minutely(spark, sf_dir)
    return latest.latest_within(rows, _last(rows) + 1000)


@query
def latest_full(spark, sf_dir):
    return _hourly_store(spark, sf_dir).latest()


@query
def latest_by_symbol_interval(spark, sf_dir):
    both = sets.union_batches(_hourly(spark, sf_dir), _minutely(spark, sf_dir))
    return latest.latest(both, ("coin", "interval"))


@query
def series_count(spark, sf_dir):
    return stats.row_counts(_minutely(spark, sf_dir))


@query
def coverage(spark, sf_dir):
    return stats.coverage(_minutely(spark, sf_dir))


@query
def count_tolerance(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    span = rows.agg((F.max(TS) - F.min(TS)).alias("span")).first().span
    return stats.count_tolerance(rows, span + HOUR_MS, HOUR_MS, 0.06)


@query
def list_directories(spark, sf_dir):
    """Next path segment below the exchange, for keys of two data frames."""
    rows = sets.union_batches(_hourly(spark, sf_dir), frames.order_candles(spark, sf_dir))
    paths = rows.select(keys.encode_path(*[F.col(name) for name in KEY]).alias("path"))
    return stats.distinct_values(paths.select(F.get(F.split("path", "/"), 2).alias("name")), "name")


# ------------------------------------------------------------------------ paging


@query
def page_limit_offset(spark, sf_dir):
    return paging.page(_minutely(spark, sf_dir), Paging(limit=100, offset=250))


@query
def page_with_copies(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    doubled = sets.union_batches(rows, rows)
    return paging.page(doubled, Paging(limit=101, offset=333), unique=False)


@query
def page_one_series(spark, sf_dir):
    key = SeriesKey(exchange="synthetic", coin="VIEW", interval="1h")
    one = _hourly_store(spark, sf_dir).read_range(key)
    return paging.page_of_one(one, Paging(limit=10, offset=20))


@query
def page_all(spark, sf_dir):
    rows = _hourly_store(spark, sf_dir).read_range()
    return paging.page(rows, Paging.all_records()).orderBy(*KEY, TS)


@query
def page_disjoint(spark, sf_dir):
    rows = _minutely(spark, sf_dir)
    first = paging.page(rows, Paging(limit=50, offset=0)).withColumn("page", F.lit(1))
    second = paging.page(rows, Paging(limit=50, offset=50)).withColumn("page", F.lit(2))
    return first.unionByName(second)


@query
def page_overlap(spark, sf_dir):
    rows = _minutely(spark, sf_dir)
    return paging.overlap(
        paging.page(rows, Paging(limit=50, offset=0)),
        paging.page(rows, Paging(limit=50, offset=40)),
    )


@query
def chunks(spark, sf_dir):
    return paging.chunks(_minutely(spark, sf_dir), 500)


# -------------------------------------------------------------- markets, membership, sets


@query
def page_walk(spark, sf_dir):
    """Consecutive pages of rows that share timestamps give every row once."""
    rows = _minutely(spark, sf_dir).withColumn(TS, floor_ms(F.col(TS), HOUR_MS))
    most = rows.groupBy(*KEY).count().agg(F.max("count")).first()[0]
    size = -(-most // 4)
    walked = [paging.page(rows, Paging(limit=size, offset=size * n)) for n in range(4)]
    return sets.union_batches(*walked)


@query
def page_stable(spark, sf_dir):
    """Pages walked by cursor while rows arrive before and behind it: each first row once, on its page."""
    rows = _hourly(spark, sf_dir)
    early = F.col("coin").isin("CLICK", "ERROR") | (F.floor(F.col(TS) / HOUR_MS) % 3 > 0)
    store = _new_store(spark)
    store.write(rows.filter(early), ingest_id=1)
    store.write(rows.filter(early & (F.col("high") > 300)), ingest_id=2)
    bound, late, cursor, found = store.snapshot(), rows.filter(~early), None, []
    most = store.inventory().agg(F.max("n_rows")).first()[0]
    size = -(-most // 4)
    for n in range(4):
        page, cursor = store.next_page(size, bound, cursor)
        found.append(page.withColumn("page", F.lit(n)))
        store.write(late.filter(F.floor(F.col(TS) / HOUR_MS) % 4 == n), ingest_id=3 + n)
    return sets.union_batches(*found)


@query
def market_available(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    return filters.with_availability(frames.requested(rows), frames.markets(rows))


def _removed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows per series: a whole day and six hours across a midnight."""
    spans = F.array(
        F.struct(F.lit(JAN_5).alias("start"), F.lit(JAN_5 + DAY_MS).alias("end")),
        F.struct(
            F.lit(JAN_10 - 3 * HOUR_MS).alias("start"), F.lit(JAN_10 + 3 * HOUR_MS).alias("end")
        ),
    )
    series = _hourly(spark, sf_dir).select(*KEY).distinct()
    return series.select(*KEY, F.inline(spans))


@query
def remove_windows(spark, sf_dir):
    return filters.remove_windows(_hourly(spark, sf_dir), _removed_windows(spark, sf_dir), KEY)


@query
def membership_split(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    members = rows.filter(F.col("high") > 300).select(TS).distinct()
    inside, outside = filters.split_by_membership(rows, members, [TS])
    return inside.withColumn("is_member", F.lit(True)).unionByName(
        outside.withColumn("is_member", F.lit(False))
    )


@query
def union_batches(spark, sf_dir):
    daily = frames.order_candles(spark, sf_dir).drop("volume")
    return sets.union_batches(_hourly(spark, sf_dir), daily.withColumn("origin", F.lit("orders")))


# ------------------------------------------------------------------- grid and gaps


@query
def expected_grid(spark, sf_dir):
    return gaps.expected_grid(_hourly(spark, sf_dir), HOUR_MS)


@query
def missing_ts(spark, sf_dir):
    return gaps.missing_timestamps(_hourly(spark, sf_dir), HOUR_MS)


@query
def missing_ts_1m(spark, sf_dir):
    return gaps.missing_timestamps(_minutely(spark, sf_dir), MINUTE_MS)


@query
def gap_ranges(spark, sf_dir):
    return gaps.gap_ranges(_hourly(spark, sf_dir), HOUR_MS)


@query
def gap_ranges_1m(spark, sf_dir):
    return gaps.gap_ranges(_minutely(spark, sf_dir), MINUTE_MS)


@query
def gap_fill(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    damaged = filters.remove_windows(rows, _removed_windows(spark, sf_dir), KEY)
    return gaps.gap_fill(damaged, rows, HOUR_MS)


@query
def completeness(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    span = rows.agg(F.min(TS).alias("first"), F.max(TS).alias("last")).first()
    bounds = frames.requested(rows).withColumns({"first_ts": F.lit(span.first), "last_ts": F.lit(span.last)})
    return gaps.completeness(rows, bounds, HOUR_MS)


# -------------------------------------------------------------------------- sync


def _partly_stored(rows: DataFrame) -> DataFrame:
    """A start state for syncs: VIEW is up to date, the other series stop on January 20."""
    return rows.filter((F.col(TS) < JAN_20) | (F.col("coin") == "VIEW"))


def _latest_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max(TS).alias("latest_ts"))


@query
def staleness(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    newest = _latest_of(_partly_stored(rows))
    return sync.staleness(frames.requested(rows), newest, _last(rows) + 1000)


@query
def sync_windows(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    newest = _latest_of(_partly_stored(rows))
    return sync.sync_windows(frames.requested(rows), newest, _last(rows) + 1000)


@query
def sync_increment(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    newest = _latest_of(_partly_stored(rows))
    windows = sync.sync_windows(frames.requested(rows), newest, _last(rows) + 1000)
    return sync.increment(rows, windows)


@query
def idempotent_append(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, _partly_stored(rows))
    store.append_new(rows)
    store.append_new(rows)
    return store.read_range()


@query
def read_through(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, _partly_stored(rows))
    return sync.read_through(
        store,
        rows,
        frames.requested(rows),
        as_of=_last(rows) + 1000,
        start=JAN_15,
        paging=Paging(limit=200, offset=100),
    )


@query
def sync_raw_symbols(spark, sf_dir):
    """A source that spells its keys as exchanges do is loaded, once."""
    rows = _hourly(spark, sf_dir)
    store = _store_of(spark, _partly_stored(rows))
    spelled = rows.withColumns(
        {"exchange": F.lit("Synthetic"), "coin": F.lower("coin"), "interval": F.upper("interval")}
    )
    for _ in range(2):
        sync.sync(store, spelled, frames.requested(rows), _last(rows) + 1000)
    return store.read_range()


@query
def sync_revised(spark, sf_dir):
    """The last stored candle of each series is corrected by the next sync; a repeat adds nothing."""
    rows = _hourly(spark, sf_dir)
    old = rows.filter(F.col(TS) < JAN_20)
    last = _latest_of(old).withColumnRenamed("latest_ts", "_last")
    wrong = old.join(last, list(KEY)).withColumn(
        "close", F.when(F.col(TS) == F.col("_last"), F.col("close") + 1).otherwise(F.col("close"))
    )
    store = _store_of(spark, wrong.select(*rows.columns))
    for _ in range(2):
        sync.sync(store, rows, last.select(*KEY), _last(rows) + 1000)
    stored = store.read_range().groupBy(*KEY, TS).count().withColumnRenamed("count", "n_versions")
    return store.read_latest_wins().join(stored, [*KEY, TS])


# ---------------------------------------------------------------------- streaming


def _landed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` as a stream of several files, one per micro-batch."""
    path = scratch_path(spark, "landed")
    rows.repartition(4).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_dedup(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    store = _new_store(spark)
    again = sets.union_batches(rows, rows.filter(F.col(TS) >= JAN_20))
    ingest_candles(_landed(spark, again), store, scratch_path(spark, "progress")).awaitTermination()
    return store.read_range()


@query
def stream_quarantine(spark, sf_dir):
    """Landed pages as a stream; every 13th hour's candle has a price that is no number."""
    bad = lambda c: F.pmod(F.floor(c[0] / HOUR_MS), F.lit(13)) == 0
    spelled = lambda c: F.array(
        c[0].cast("bigint").cast("string"),
        *[c[n].cast("string") for n in (1, 2, 3)],
        F.when(bad(c), F.lit("not-a-number")).otherwise(c[4].cast("string")),
        c[5].cast("string"),
    )
    landed = scratch_path(spark, "pages")
    given = frames.raw_pages(_hourly(spark, sf_dir)).withColumn("candles", F.transform("candles", spelled))
    given.repartition(3).write.json(landed)
    stream = spark.readStream.schema(pages.PAGE_SCHEMA).option("maxFilesPerTrigger", 1).json(landed)
    store, folder = _new_store(spark), scratch_path(spark, "quarantine")
    progress = scratch_path(spark, "progress")
    ingest_pages(stream, store, progress, quarantine=folder).awaitTermination()
    rejected = read_quarantine(spark, folder).select(
        *KEY, F.get_json_object("raw", f"$.{TS}").cast("bigint").alias(TS), "reject_reason"
    )
    return sets.union_batches(store.read_range().withColumn("reject_reason", F.lit(None)), rejected)


@query
def stream_candles_1h(spark, sf_dir):
    ticks = frames.event_ticks(frames.table(spark, sf_dir, "events"))
    store = _new_store(spark)
    # Two batches a run, so that the four batches here are merged on two levels.
    stream_candles(
        _landed(spark, ticks), "1h", store, scratch_path(spark, "progress"), fan=2
    ).awaitTermination()
    return store.read_latest_wins()
