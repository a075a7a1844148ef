import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import DAY_1, as_tuples, candle, frame, hours, stamps, synthetic
from wickstore import NO_DATE, YEAR_MONTH, CandleStore, SeriesKey
from wickstore.operators import gaps, sets
from wickstore.schema import DAY_MS, HOUR_MS, KEY, TS, VALUES

BTC = SeriesKey(exchange="binance", coin="BTC/USD", interval="1h")


@pytest.fixture
def store(spark, tmp_path):
    return CandleStore(spark, str(tmp_path / "store"))


def files(store):
    return sorted(str(path) for path in Path(store.root).rglob("*.parquet"))


def test_round_trip(spark, store):
    rows = frame(spark, hours(DAY_1, 10)).withColumn("value", F.lit(7).cast("long"))
    store.write(rows, mode="overwrite")
    back = store.read_range()
    assert sorted(back.columns) == sorted(rows.columns)
    only_in, only_out = sets.differences(rows, back)
    assert only_in.isEmpty() and only_out.isEmpty()


def test_keys_are_normalised_on_write(spark, store):
    rows = frame(spark, [candle(DAY_1)])
    untidy = rows.withColumns({"coin": F.lit(" btc/usd "), "exchange": F.lit("Bi Nance")})
    store.write(untidy)
    assert as_tuples(store.read_range(), "exchange", "coin") == [("bi_nance", "BTC_USD")]


def test_coin_names_that_look_like_numbers_or_need_escapes(spark, store):
    coins = ["1E3", "007", "BTC_USDT:USDT", "A=B", "X%Y", "É"]
    store.write(frame(spark, [candle(DAY_1, coin) for coin in coins]))
    assert sorted(row.coin for row in store.list_coins("binance").collect()) == sorted(coins)
    for coin in coins:
        assert store.exists(SeriesKey(exchange="binance", coin=coin, interval="1h"))
    gone = store.read_range(columns=KEY).filter(F.col("coin").isin("A=B", "BTC_USDT:USDT"))
    assert store.drop_series(gone.distinct()) == 2
    assert sorted(row.coin for row in store.series().collect()) == sorted(
        set(coins) - {"A=B", "BTC_USDT:USDT"}
    )


def test_empty_and_absent(spark, store, tmp_path):
    assert store.read_range(BTC).count() == 0
    assert not store.exists(BTC)
    assert store.latest().count() == 0
    assert store.inventory().count() == 0
    assert store.list_coins("nowhere").count() == 0
    store.write(frame(spark, []))
    assert files(store) == []
    store.write(frame(spark, hours(DAY_1, 3)))
    store.write(frame(spark, []), mode="overwrite")
    assert store.read_range().count() == 3
    assert store.read_range(SeriesKey(exchange="other")).count() == 0


def test_other_read_errors_are_raised(spark, tmp_path):
    with pytest.raises(Exception):
        CandleStore(spark, "no-such-scheme://x/y").read_range().count()


def test_invalid_rows_fail_the_write(spark, store):
    rows = frame(spark, [candle(DAY_1)])
    for broken in (
        rows.withColumn("coin", F.lit(" ")),
        rows.withColumn("interval", F.lit(None).cast("string")),
        rows.withColumn(TS, F.lit(None).cast("long")),
    ):
        with pytest.raises(Exception, match="empty|null"):
            store.write(broken)
    assert store.read_range().count() == 0
    with pytest.raises(ValueError):
        store.write(rows.drop("coin"))
    with pytest.raises(ValueError):
        store.write(rows, mode="replace")


def test_range_bounds_are_closed_and_optional(spark, store):
    store.write(frame(spark, hours(DAY_1, 72)))
    start = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    end = dt.datetime(2024, 1, 2, 23)
    assert stamps(store.read_range(BTC, start, end)) == [
        DAY_1 + n * HOUR_MS for n in range(24, 48)
    ]
    assert store.read_range(BTC, start=start).count() == 48
    assert store.read_range(BTC, end=start).count() == 25
    assert store.read_range(BTC, DAY_1 + 1, DAY_1 + HOUR_MS - 1).count() == 0


def test_projection_without_filter_columns(spark, store):
    store.write(frame(spark, hours(DAY_1, 5)))
    got = store.read_range(BTC, columns=["close"], where=[("open", ">", 102.0), (TS, ">", DAY_1)])
    assert got.columns == ["close"]
    assert sorted(row.close for row in got.collect()) == [104.0, 105.0]


def test_gap_scenario(spark, store):
    """Three days with two holes: find, fill, complete, then append half hours."""
    full = hours(DAY_1, 72)
    store.write(frame(spark, hours(DAY_1, 72, skip=(12, 24))), mode="overwrite")
    held = store.read_range(BTC)
    assert held.count() == 70
    assert stamps(gaps.missing_timestamps(held, HOUR_MS)) == [
        DAY_1 + 12 * HOUR_MS,
        DAY_1 + 24 * HOUR_MS,
    ]
    store.write(gaps.gap_fill(held, frame(spark, full), HOUR_MS))
    assert store.read_range(BTC).count() == 72
    assert gaps.missing_timestamps(store.read_range(BTC), HOUR_MS).isEmpty()
    day_3 = DAY_1 + 2 * DAY_MS
    half = [candle(day_3 + 10 * HOUR_MS + n * HOUR_MS // 2, value=1000.0 + n) for n in (1, 2, 3)]
    store.write(frame(spark, half), ingest_id=2**60)
    assert store.read_range(BTC).count() == 75
    assert store.read_range(BTC, DAY_1, DAY_1 + DAY_MS - 1).count() == 24
    eleven = day_3 + 11 * HOUR_MS
    assert store.read_range(BTC, eleven, eleven).count() == 2
    assert [row.open for row in store.read_latest_wins(BTC, eleven, eleven).collect()] == [1002.0]
    assert store.read_latest_wins(BTC).count() == 74


def test_overwrite_replaces_whole_series_only(spark, store):
    store.write(frame(spark, hours(DAY_1, 72) + hours(DAY_1, 72, "ETH_USD")))
    store.write(frame(spark, hours(DAY_1 + DAY_MS, 5)), mode="overwrite")
    assert stamps(store.read_range(BTC)) == [DAY_1 + DAY_MS + n * HOUR_MS for n in range(5)]
    assert store.read_range(SeriesKey(coin="ETH_USD")).count() == 72


def test_overwrite_from_the_store_itself(spark, store):
    store.write(frame(spark, hours(DAY_1, 48)))
    shifted = store.read_range().withColumn("close", F.col("close") * 2)
    store.write(shifted.filter(F.col(TS) >= DAY_1 + DAY_MS), mode="overwrite")
    got = store.read_range().orderBy(TS).collect()
    assert len(got) == 24 and got[0].close == 2 * 125.0


def test_other_layouts(spark, tmp_path):
    rows = frame(spark, hours(DAY_1, 24 * 40))
    for layout, folders in ((NO_DATE, 1), (YEAR_MONTH, 2)):
        store = CandleStore(spark, str(tmp_path / layout.name), layout)
        store.write(rows)
        assert store.read_range().count() == 960
        assert len({os.path.dirname(name) for name in files(store)}) == folders
        assert store.read_range(BTC, DAY_1 + 35 * DAY_MS, DAY_1 + 36 * DAY_MS - 1).count() == 24
        assert store.latest().first()[TS] == DAY_1 + 959 * HOUR_MS
        store.write(frame(spark, hours(DAY_1, 3)), mode="overwrite")
        assert store.read_range().count() == 3
        store.append_new(frame(spark, hours(DAY_1, 5)))
        assert store.read_range().count() == 5


def test_schema_grows_and_types_stay(spark, store):
    store.write(frame(spark, hours(DAY_1, 2)))
    wider = frame(spark, hours(DAY_1 + DAY_MS, 2)).withColumns(
        {"trades": F.lit(3).cast("long"), "note": F.lit(None), "volume": F.lit(5)}
    )
    store.write(wider)
    back = store.read_range().orderBy(TS)
    assert dict(back.dtypes)["note"] == "string" and dict(back.dtypes)["volume"] == "double"
    assert [row.trades for row in back.collect()] == [None, None, 3, 3]
    whole = frame(spark, hours(DAY_1 + 2 * DAY_MS, 1)).withColumn("trades", F.lit(4.0))
    store.write(whole)
    assert store.read_range(start=DAY_1 + 2 * DAY_MS).first().trades == 4
    with pytest.raises(Exception, match="whole numbers"):
        store.write(whole.withColumn("trades", F.lit(4.5)))


def test_timestamp_typed_input(spark, store):
    rows = frame(spark, hours(DAY_1, 2)).withColumn(TS, F.timestamp_millis(TS))
    store.write(rows)
    assert stamps(store.read_range()) == [DAY_1, DAY_1 + HOUR_MS]


def test_append_new_is_idempotent(spark, store):
    rows = frame(spark, hours(DAY_1, 30) + hours(DAY_1, 30, "ETH_USD"))
    store.append_new(rows.filter(F.col(TS) < DAY_1 + 20 * HOUR_MS))
    for _ in range(2):
        store.append_new(rows.unionByName(rows))
    assert store.read_range().count() == 60
    before = files(store)
    store.append_new(rows)
    store.append_new(rows.limit(0))
    assert files(store) == before


def test_catalog(spark, store):
    store.write(frame(spark, hours(DAY_1, 30) + hours(DAY_1, 2, "ETH_USD")))
    store.write(frame(spark, [candle(DAY_1, interval="1d")]))
    assert [row.coin for row in store.list_coins("Binance").collect()] == ["BTC_USD", "ETH_USD"]
    assert store.exists(SeriesKey(exchange="binance", coin="btc/usd"))
    assert not store.exists(SeriesKey(exchange="binance", coin="btc/usd", interval="5m"))
    listed = {(row.coin, row.interval): row for row in store.inventory().collect()}
    assert listed["BTC_USD", "1h"].n_rows == 30 and listed["BTC_USD", "1h"].n_files == 2
    assert listed["BTC_USD", "1h"].last_ts == DAY_1 + 29 * HOUR_MS
    newest = {row.coin: row[TS] for row in store.latest(SeriesKey(interval="1h")).collect()}
    assert newest == {"BTC_USD": DAY_1 + 29 * HOUR_MS, "ETH_USD": DAY_1 + HOUR_MS}
    wanted = frame(spark, [candle(0, "btc/usd"), candle(0, "XRP_USD")]).select(*KEY)
    assert as_tuples(store.which_exist(wanted), "coin", "is_stored") == [
        ("BTC_USD", True),
        ("XRP_USD", False),
    ]


def test_drop_series(spark, store):
    store.write(frame(spark, hours(DAY_1, 30) + hours(DAY_1, 2, "ETH_USD")))
    gone = frame(spark, [candle(0, "eth/usd"), candle(0, "XRP")]).select(*KEY)
    assert store.drop_series(gone) == 1
    assert store.drop_series(gone) == 0
    assert [row.coin for row in store.series().collect()] == ["BTC_USD"]


def test_hot_partition_is_written_whole(spark, store):
    """A third of all rows are copies of one candle."""
    copies = spark.range(3000).select(
        *[F.lit(cell).alias(name) for name, cell in zip((*KEY, TS, *VALUES), candle(DAY_1))]
    )
    rows = copies.unionByName(frame(spark, hours(DAY_1 + HOUR_MS, 6000)))
    store.write(rows)
    assert store.read_range().count() == 9000
    assert store.read_latest_wins().count() == 6001


def test_scan_skips_files_by_date_and_series(spark, store):
    store.write(frame(spark, hours(DAY_1, 24 * 30) + hours(DAY_1, 24 * 30, "ETH_USD")))
    assert len(files(store)) == 60

    def files_read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return plan.collectLeaves().head().metrics().apply("numFiles").value()

    two_days = (DAY_1 + DAY_MS, DAY_1 + 3 * DAY_MS - 1)
    assert files_read(store.read_range(None, *two_days, prune_dates=False)) == 60
    assert files_read(store.read_range(None, *two_days)) == 4
    assert files_read(store.read_range(BTC, *two_days)) == 2
    plan = store.read_range(BTC, *two_days, columns=["close"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,close:double>" in plan


def test_synthetic_grid_round_trip(spark, store):
    grid = synthetic(spark, DAY_1, 200, HOUR_MS // 4, seed=7)
    assert grid.filter("high < greatest(open, close) or low > least(open, close)").isEmpty()
    store.write(grid)
    only_in, only_out = sets.differences(grid, store.read_range())
    assert only_in.isEmpty() and only_out.isEmpty()
    assert gaps.missing_timestamps(store.read_range(), HOUR_MS // 4).isEmpty()


def test_many_series_use_the_wider_scan(spark, store, monkeypatch):
    """Beyond the listing limits the predicates are wider and the results the same."""
    from wickstore.sources import store as module

    rows = frame(spark, [row for n in range(6) for row in hours(DAY_1, 4, f"C{n}")])
    for listed, folders in ((1000, 3), (3, 100)):
        monkeypatch.setattr(module, "MAX_LISTED", listed)
        monkeypatch.setattr(module, "MAX_FOLDERS", folders)
        fresh = CandleStore(spark, f"{store.root}-{listed}")
        fresh.append_new(rows.filter(F.col(TS) < DAY_1 + 2 * HOUR_MS))
        fresh.append_new(rows)
        assert fresh.read_range().count() == 24
        assert fresh.latest().count() == 6
        assert fresh.last_timestamps(rows.select(*KEY)).count() == 6
        assert fresh.drop_series(rows.select(*KEY).filter("coin <> 'C0'").distinct()) == 5
        assert [row.coin for row in fresh.series().collect()] == ["C0"]


def test_overwrite_keeps_every_row_of_an_input_that_changes(spark, store):
    rows = frame(spark, hours(DAY_1, 60)).withColumn(
        TS, F.col(TS) + (F.rand() * 20).cast("int") * DAY_MS
    )
    store.write(rows, mode="overwrite")
    assert store.read_range().count() == 60


def test_append_new_takes_corrections_once(spark, store):
    rows = frame(spark, hours(DAY_1, 5))
    store.append_new(rows)
    changed = rows.withColumn("close", F.when(F.col(TS) == DAY_1, 5.0).otherwise(F.col("close")))
    for _ in range(2):
        store.append_new(changed)
    assert store.read_range().count() == 6
    assert store.read_latest_wins().filter(F.col(TS) == DAY_1).first()["close"] == 5.0


def test_write_needs_the_whole_record(spark, store):
    with pytest.raises(ValueError, match="close"):
        store.write(frame(spark, hours(DAY_1, 5)).drop("close"))


def test_time_conditions_skip_files(spark, store):
    store.write(frame(spark, hours(DAY_1, 240)))
    cut = DAY_1 + 9 * DAY_MS
    some = store.read_range(where=[(TS, ">", cut), (TS, "<=", cut + 2 * HOUR_MS), ("close", "!=", -1.0)])
    assert stamps(some) == [cut + HOUR_MS, cut + 2 * HOUR_MS]
    assert len(some.inputFiles()) >= 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "make_date" in plan
