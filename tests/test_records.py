import pytest
from pyspark.sql import functions as F

from helpers import DAY_1, frame, hours, stamps
from wickstore.operators import convert, filters, latest, sets, stats
from wickstore.schema import BASE_RECORD, CANDLE_RECORD, HOUR_MS, KEY, TS
from wickstore.sources import infer, pages, ticks

RAW = "timestamp string, open string, high string, low string, close string, volume string"
GOOD = ("1678886400000", "100.0", "105.0", "98.5", "102.5", "5000.0")


def reasons(spark, rows, schema=RAW, record=CANDLE_RECORD):
    checked = filters.validate(spark.createDataFrame(rows, schema), record)
    return [row.reject_reason for row in checked.collect()]


def test_good_row_is_typed(spark):
    valid, rejected = filters.split_valid(spark.createDataFrame([GOOD], RAW), CANDLE_RECORD)
    assert tuple(valid.first()) == (1678886400000, 100.0, 105.0, 98.5, 102.5, 5000.0)
    assert rejected.isEmpty()


@pytest.mark.parametrize(
    "change, reason",
    [
        ({4: None}, "missing: close"),
        ({1: None, 5: None}, "missing: open,volume"),
        ({1: "not-a-number"}, "type: open"),
        ({0: "1678886400000.5"}, "type: timestamp"),
        ({0: "yesterday"}, "type: timestamp"),
        ({5: "true"}, "type: volume"),
        ({0: None, 1: "x"}, "missing: timestamp"),
    ],
)
def test_bad_rows(spark, change, reason):
    row = tuple(change.get(i, cell) for i, cell in enumerate(GOOD))
    assert reasons(spark, [row]) == [reason]


def test_typed_columns_of_the_wrong_kind(spark):
    fraction = "timestamp double, open double, high double, low double, close double, volume double"
    assert reasons(spark, [(1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], fraction) == ["type: timestamp"]
    flags = RAW.replace("open string", "open boolean")
    assert reasons(spark, [(GOOD[0], True, *GOOD[2:])], flags) == ["type: open"]


def test_absent_column_and_extras(spark):
    rows = spark.createDataFrame([("1", "a")], "timestamp string, label string")
    checked = filters.validate(rows, CANDLE_RECORD).first()
    assert checked.label == "a"
    assert checked.reject_reason == "missing: open,high,low,close,volume"
    assert reasons(spark, [("5", "a")], "timestamp string, label string", BASE_RECORD) == [None]


def test_pages_report_bad_candles(spark, tmp_path):
    page = (
        '{"data_type":"ohlcv","exchange":"binance","coin":"BTC/USD","interval":"1h",'
        '"candles":[[1704067200000,1,2,0.5,1.5,10],[1704070800000,"x",2,1,1,1],'
        "[1704074400000,1,2,1],[1704078000000,1,2,1,1,7]]}"
    )
    (tmp_path / "page.json").write_text(page + "\n")
    valid, rejected = pages.candles_from_pages(
        pages.read_pages(spark, str(tmp_path)), DAY_1, DAY_1 + 3 * HOUR_MS
    )
    assert stamps(valid) == [DAY_1]  # the last one is at the open end of the range
    assert sorted(row.reject_reason for row in rejected.collect()) == [
        "missing: close,volume",
        "type: open",
    ]


def test_page_plan_covers_the_range_once(spark):
    requests = spark.createDataFrame(
        [
            ("ohlcv", "b", "A", "1m", 0, 150_000_000),
            ("ohlcv", "b", "B", "1m", 5, 5),
        ],
        "data_type string, exchange string, coin string, interval string, start long, end long",
    )
    with pytest.raises(Exception, match="unknown interval: x"):
        pages.page_plan(requests.withColumn("interval", F.lit("x"))).collect()
    plan = pages.page_plan(requests).orderBy("page").collect()
    assert {row.coin for row in plan} == {"A"}
    assert [(row.page, row.page_start, row.page_end) for row in plan] == [
        (0, 0, 60_000_000),
        (1, 60_000_000, 120_000_000),
        (2, 120_000_000, 150_000_000),
    ]


def test_candles_from_ticks_break_ties_by_id(spark):
    rows = [
        ("ohlcv", "b", "A", 1_000_000, 2, 20.0, 0.125),
        ("ohlcv", "b", "A", 1_000_000, 1, 10.0, 1.0),
        ("ohlcv", "b", "A", 59_999_999, -5, 7.0, 1.0),
        ("ohlcv", "b", "A", 59_999_999, 3, 8.0, 1.0),
        ("ohlcv", "b", "A", 60_000_000, 4, 5.0, 1.0),
        ("ohlcv", "b", "A", -1, 9, 6.0, 1.0),
    ]
    frame_ = spark.createDataFrame(
        rows,
        "data_type string, exchange string, coin string, micros long, tick_id long,"
        " price double, size double",
    )
    got = ticks.candles_from_ticks(frame_, "1m").orderBy(TS).collect()
    assert [tuple(row)[4:] for row in got] == [
        (-60_000, 6.0, 6.0, 6.0, 6.0, 1.0),
        (0, 10.0, 20.0, 7.0, 8.0, 3.125),
        (60_000, 5.0, 5.0, 5.0, 5.0, 1.0),
    ]


def test_time_filters(spark):
    rows = frame(spark, hours(DAY_1, 5))
    closed = filters.time_between(rows, DAY_1 + HOUR_MS, DAY_1 + 3 * HOUR_MS)
    assert closed.count() == 3
    assert filters.time_between(rows, None, DAY_1).count() == 1
    assert filters.time_between(rows).count() == 5
    assert filters.clip(rows, DAY_1 // 1000, DAY_1 // 1000 + 7200).count() == 2
    back = filters.lookback(rows, DAY_1 + 4 * HOUR_MS, 2 * HOUR_MS)
    assert stamps(back) == [DAY_1 + n * HOUR_MS for n in (2, 3, 4)]
    untimed = rows.select("coin")
    assert filters.time_between(untimed, DAY_1, DAY_1).count() == 5


def test_timestamp_column_is_found(spark):
    rows = spark.range(1).select(F.lit(1).alias("a"), F.current_timestamp().alias("seen"))
    assert filters.resolve_ts_column(rows, "a") == "a"
    assert filters.resolve_ts_column(rows, "other") == "seen"
    assert filters.resolve_ts_column(rows.select("a"), "other") is None


def test_conditions(spark):
    rows = frame(spark, hours(DAY_1, 6))
    kept = filters.where_all(
        rows, [("open", ">=", 101.0), ("open", "<", 105.0), ("open", "not in", [103.0])]
    )
    assert sorted(row.open for row in kept.collect()) == [101.0, 102.0, 104.0]
    with pytest.raises(ValueError):
        filters.where_all(rows, [("open", "like", 1)])


def test_remove_windows_is_half_open_and_per_series(spark):
    rows = frame(spark, hours(DAY_1, 60) + hours(DAY_1, 60, "ETH_USD"))
    windows = spark.createDataFrame(
        [
            ("BTC_USD", DAY_1 + 20 * HOUR_MS, DAY_1 + 50 * HOUR_MS),
            ("BTC_USD", DAY_1 + 55 * HOUR_MS, DAY_1 + 55 * HOUR_MS),
        ],
        "coin string, start long, end long",
    )
    kept = filters.remove_windows(rows, windows, ["coin"])
    btc = stamps(kept.filter("coin = 'BTC_USD'"))
    assert btc == [DAY_1 + n * HOUR_MS for n in range(60) if not 20 <= n < 50]
    assert kept.filter("coin = 'ETH_USD'").count() == 60
    everywhere = filters.remove_windows(rows, windows.drop("coin"))
    assert everywhere.count() == 60


def test_latest_picks_one_whole_row(spark):
    rows = frame(spark, hours(DAY_1, 30) + hours(DAY_1, 10, "ETH_USD") * 3)
    newest = {row.coin: row for row in latest.latest(rows).collect()}
    assert newest["BTC_USD"].open == 129.0 and newest["ETH_USD"].open == 109.0
    as_of = DAY_1 + 40 * HOUR_MS
    assert [row.coin for row in latest.latest_within(rows, as_of).collect()] == ["BTC_USD"]
    named = rows.withColumn("note", F.concat(F.lit("n"), "open"))
    assert {row.note for row in latest.latest(named).collect()} == {"n129.0", "n109.0"}


def test_latest_breaks_ties_the_same_way(spark):
    rows = frame(spark, hours(DAY_1, 1)).withColumn("ingest_id", F.lit(1))
    newer = rows.withColumns({"open": F.lit(7.0), "ingest_id": F.lit(2)})
    both = rows.unionByName(newer)
    assert latest.latest_wins(both, "ingest_id").first().open == 7.0
    assert latest.latest(both, tie="ingest_id").first().open == 7.0
    picks = {latest.latest(both.repartition(n)).first().open for n in (1, 2, 5)}
    assert len(picks) == 1


def test_latest_keeps_null_values_of_the_winner(spark):
    rows = frame(spark, hours(DAY_1, 3)).withColumn(
        "volume", F.when(F.col(TS) < DAY_1 + 2 * HOUR_MS, F.col("volume"))
    )
    assert latest.latest(rows).first().volume is None


def test_stats(spark):
    rows = frame(spark, hours(DAY_1, 24, skip=(3, 4)))
    assert stats.row_counts(rows).first().n_rows == 22
    span = stats.coverage(rows).first()
    assert (span.first_ts, span.last_ts, span.n_rows) == (DAY_1, DAY_1 + 23 * HOUR_MS, 22)
    day = 24 * HOUR_MS
    assert stats.count_tolerance(rows, day, HOUR_MS).first().within
    assert not stats.count_tolerance(rows, day, HOUR_MS, 0.05).first().within


def test_union_widens_types(spark):
    a = spark.createDataFrame([(1, 1, None)], "k int, v int, n void")
    b = spark.createDataFrame([(2, 2.5, "x")], "k int, v double, extra string")
    both = sets.union_batches(a, b)
    assert dict(both.dtypes) == {"k": "int", "v": "double", "n": "string", "extra": "string"}
    assert both.count() == 2


def test_infer_types(spark):
    records = spark.createDataFrame(
        [
            ('{"id": 1, "price": 2, "flag": true, "mixed": 1, "none": null, "deep": {"a": 1}}',),
            ('{"id": 2, "price": 2.5, "mixed": "x", "none": null, "late": "y"}',),
            ('{"id": null, "price": 1e30, "flag": false, "mixed": true}',),
        ],
        "record string",
    )
    types = {row.column: row.type for row in infer.infer_types(records, "record").collect()}
    assert types == {
        "id": "BIGINT",
        "price": "DOUBLE",
        "flag": "BOOLEAN",
        "mixed": "STRING",
        "none": "STRING",
        "deep": "STRING",
        "late": "STRING",
    }
    typed = infer.typed_records(records, "record")
    assert dict(typed.dtypes)["price"] == "double"
    assert sorted(row.price for row in typed.collect()) == [2.0, 2.5, 1e30]
    with pytest.raises(ValueError):
        infer.to_struct(infer.infer_types(records.limit(0), "record"))


def test_convert_at_the_edge(spark):
    rows = frame(spark, hours(DAY_1, 3))
    as_pandas = convert.convert(rows, "pandas")
    assert str(as_pandas[TS].dtype).endswith("UTC]")
    assert int(as_pandas[TS].min().timestamp() * 1000) == DAY_1
    as_arrow = convert.convert(rows, "arrow")
    assert str(as_arrow.schema.field(TS).type) == "timestamp[ms, tz=UTC]"
    assert as_arrow.num_rows == 3
    assert convert.convert(rows, "spark") is rows
    assert len(convert.convert(rows.limit(0), "pandas")) == 0
    assert convert.convert(rows.limit(0), "arrow").num_rows == 0
    with pytest.raises(ValueError):
        convert.convert(rows, "csv")
    with pytest.raises(ValueError):
        convert.to_pandas(rows, max_rows=2)


def test_membership_and_markets(spark):
    rows = frame(spark, hours(DAY_1, 4) + hours(DAY_1, 2, "ETH_USD"))
    members = spark.createDataFrame([(DAY_1,), (DAY_1,)], "timestamp long")
    inside, outside = filters.split_by_membership(rows, members, [TS])
    assert (inside.count(), outside.count()) == (2, 4)
    markets = rows.filter("coin = 'BTC_USD'").select("exchange", "coin")
    flagged = filters.with_availability(rows.select(*KEY).distinct(), markets)
    assert {row.coin: row.is_available for row in flagged.collect()} == {
        "BTC_USD": True,
        "ETH_USD": False,
    }


@pytest.mark.parametrize("low, high", [(-(2**63), 2**63 - 1), (-1, 0), (2**62, 2**62 + 1)])
def test_order_covers_every_long(spark, low, high):
    rows = frame(spark, hours(DAY_1, 1))
    both = rows.withColumns({"open": F.lit(1.0), "ingest_id": F.lit(low)}).unionByName(
        rows.withColumns({"open": F.lit(2.0), "ingest_id": F.lit(high)})
    )
    assert latest.latest_wins(both, "ingest_id").first().open == 2.0


def test_no_page_is_lost(spark, tmp_path):
    good = '{"data_type":"ohlcv","exchange":"Binance","coin":"btc/usd","interval":"1H","candles":[[1704067200000,1,2,0.5,1.5,3]]}'
    seven = good.replace("1.5,3]", "1.5,3,4]")
    word = good.replace("0.5", '"1d"')
    lines = [good, "not json", good.replace("[[1704067200000,1,2,0.5,1.5,3]]", "null"), seven, word]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    valid, rejected = pages.candles_from_pages(pages.read_pages(spark, str(tmp_path)))
    assert [(r.exchange, r.coin, r.interval) for r in valid.collect()] == [("binance", "BTC_USD", "1h")]
    assert rejected.count() == 4


def test_small_sizes_add_up(spark):
    rows = [("ohlcv", "x", "A", n, n, 1.0, 0.004) for n in range(100)]
    frame_ = spark.createDataFrame(
        rows, "data_type string, exchange string, coin string, micros long, tick_id long, price double, size double"
    )
    assert ticks.candles_from_ticks(frame_, "1m").first()["volume"] == 0.4


def test_union_keeps_times_and_decimals(spark):
    a = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS timestamp, CAST(1.25 AS DECIMAL(10, 2)) AS v")
    b = spark.sql("SELECT CAST(5 AS BIGINT) AS timestamp, CAST(7 AS BIGINT) AS v")
    both = sets.union_batches(a, b)
    assert sorted(row["timestamp"] for row in both.collect()) == [5, 1704067200000]
    assert dict(both.dtypes)["v"] == "decimal(21,2)"
