"""Paging, grids and syncs against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DAY_1, as_tuples, candle, frame, hours, stamps
from wickstore import CandleStore, SeriesKey
from wickstore.operators import gaps, paging, sync
from wickstore.operators.paging import Paging
from wickstore.schema import DAY_MS, HOUR_MS, KEY, TS


def test_paging_values():
    assert not Paging.all_records().has_pagination()
    assert Paging(limit=0).has_pagination() and Paging(offset=1).has_pagination()


@pytest.mark.parametrize("limit, offset", [(10, 0), (5, 5), (7, 40), (None, 55), (10, 1000), (0, 3)])
def test_page_of_every_series(spark, limit, offset):
    sizes = {"BTC_USD": 60, "ETH_USD": 45, "XRP_USD": 3}
    rows = [row for coin, size in sizes.items() for row in hours(DAY_1, size, coin)]
    random.Random(1).shuffle(rows)
    got = as_tuples(paging.page(frame(spark, rows), Paging(limit, offset)), "coin", TS)
    end = None if limit is None else offset + limit
    want = sorted(
        (coin, DAY_1 + n * HOUR_MS)
        for coin, size in sizes.items()
        for n in range(size)[offset:end]
    )
    assert got == want


def test_pages_are_disjoint_repeatable_and_cover_all(spark):
    rows = frame(spark, hours(DAY_1, 25)).repartition(4)
    pages = [paging.page(rows, Paging(10, offset)) for offset in (0, 10, 20)]
    assert [page.count() for page in pages] == [10, 10, 5]
    assert paging.overlap(pages[0], pages[1]).first().n_shared == 0
    assert stamps(pages[1]) == stamps(paging.page(rows.repartition(3), Paging(10, 10)))
    assert sorted(sum((stamps(page) for page in pages), [])) == stamps(rows)


@pytest.mark.parametrize("limit, offset", [(50, 0), (1500, 10), (None, 2990), (40, 2980), (5, 9000)])
def test_page_with_hot_copies_and_revisions(spark, limit, offset):
    """One timestamp holds 2,000 copies of a row and 900 different rows."""
    base = frame(spark, [candle(DAY_1)])
    copies = base.crossJoin(spark.range(2000)).drop("id")
    revisions = base.crossJoin(spark.range(900)).withColumn("close", F.col("id") * 1.0).drop("id")
    rows = copies.unionByName(revisions).unionByName(frame(spark, hours(DAY_1 + HOUR_MS, 100)))
    placed = paging.with_position(rows, Paging(limit, offset), unique=False)
    got = sorted(row.position for row in placed.select("position").collect())
    end = 3000 if limit is None else min(offset + limit, 3000)
    assert got == list(range(offset, end))


def test_positions_of_copies_keep_every_row(spark):
    rows = frame(spark, hours(DAY_1, 30) * 3)
    placed = paging.with_position(rows, unique=False)
    assert placed.drop("position").exceptAll(rows).isEmpty()
    assert rows.exceptAll(placed.drop("position")).isEmpty()
    order = [row[TS] for row in placed.orderBy("position").collect()]
    assert order == sorted(order) and len(order) == 90


def test_page_of_one_series(spark):
    rows = frame(spark, hours(DAY_1, 60))
    shallow = [row[TS] for row in paging.page_of_one(rows, Paging(10, 5)).collect()]
    assert shallow == [DAY_1 + n * HOUR_MS for n in range(5, 15)]
    deep = paging.page_of_one(rows, Paging(20_000, 55))
    assert [row[TS] for row in deep.collect()] == [DAY_1 + n * HOUR_MS for n in range(55, 60)]
    assert paging.page_of_one(rows) is rows


def test_chunks(spark, tmp_path):
    rows = frame(spark, hours(DAY_1, 25) + hours(DAY_1, 10, "ETH_USD"))
    chunked = paging.chunks(rows, 10)
    sizes = chunked.groupBy("coin", "chunk_id").count()
    assert as_tuples(sizes, "coin", "chunk_id", "count") == [
        ("BTC_USD", 0, 10),
        ("BTC_USD", 1, 10),
        ("BTC_USD", 2, 5),
        ("ETH_USD", 0, 10),
    ]
    paging.write_chunks(chunked, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 35


def brute_missing(times, step):
    held = set(times)
    return [t for t in range(min(times), max(times) + 1, step) if t not in held]


def brute_ranges(missing, step):
    ranges = []
    for t in missing:
        if ranges and ranges[-1][1] + step == t:
            ranges[-1][1] = t
        else:
            ranges.append([t, t])
    return [(a, b, (b - a) // step + 1) for a, b in ranges]


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    slots=st.lists(st.integers(-9000, 9000), min_size=1, max_size=40),
    phase=st.integers(0, 999),
    strays=st.lists(st.integers(-9_000_000, 9_000_000), max_size=5),
)
def test_gaps_against_brute_force(spark, slots, phase, strays):
    """Negative times, copies, rows off the grid and holes longer than a grid piece."""
    step = 1000
    times = [slot * step + phase for slot in slots]
    first, last = min(times), max(times)
    times += [t for t in strays if first < t < last] + times[:3]
    df = spark.createDataFrame([("A", t) for t in times], "coin string, timestamp long")
    missing = brute_missing(times, step)
    got = sorted(row[TS] for row in gaps.missing_timestamps(df, step, ["coin"]).collect())
    assert got == missing
    ranges = gaps.gap_ranges(df, step, ["coin"])
    assert as_tuples(ranges, "gap_start", "gap_end", "n_missing") == brute_ranges(missing, step)


def test_grid_end_after_last_on_grid_row(spark):
    times = [0, 1000, 4500]
    df = spark.createDataFrame([("A", t) for t in times], "coin string, timestamp long")
    assert as_tuples(gaps.gap_ranges(df, 1000, ["coin"]), "gap_start", "gap_end") == [(2000, 4000)]
    assert stamps(gaps.missing_timestamps(df, 1000, ["coin"])) == [2000, 3000, 4000]
    assert stamps(gaps.expected_grid(df, 1000, ["coin"])) == [0, 1000, 2000, 3000, 4000]


def test_long_grid_is_split(spark):
    span = 3 * gaps.GRID_PIECE
    df = spark.createDataFrame([("A", 0), ("A", span)], "coin string, timestamp long")
    assert gaps.expected_grid(df, 1, ["coin"]).count() == span + 1
    assert gaps.missing_timestamps(df, 1, ["coin"]).count() == span - 1
    assert as_tuples(gaps.gap_ranges(df, 1, ["coin"]), "gap_start", "gap_end", "n_missing") == [
        (1, span - 1, span - 1)
    ]


def test_completeness_of_requested_bounds(spark):
    rows = frame(spark, hours(DAY_1, 24) * 2 + hours(DAY_1, 24, "ETH_USD", skip=(0, 23)))
    wanted = frame(spark, [candle(0, coin) for coin in ("BTC_USD", "ETH_USD", "XRP_USD")])
    bounds = wanted.select(*KEY).withColumns(
        {"first_ts": F.lit(DAY_1), "last_ts": F.lit(DAY_1 + 23 * HOUR_MS)}
    )
    got = gaps.completeness(rows, bounds, HOUR_MS)
    assert as_tuples(got, "coin", "n_expected", "n_present", "is_complete") == [
        ("BTC_USD", 24, 24, True),
        ("ETH_USD", 24, 22, False),
        ("XRP_USD", 24, 0, False),
    ]


NOW = DAY_1 + 30 * HOUR_MS


def test_staleness_and_windows(spark):
    wanted = frame(spark, [candle(0, c) for c in ("FRESH", "EDGE", "OLD", "NONE")]).select(*KEY)
    newest = frame(
        spark, [candle(NOW - 1, "FRESH"), candle(NOW - HOUR_MS, "EDGE"), candle(DAY_1, "OLD")]
    ).select(*KEY, F.col(TS).alias("latest_ts"))
    state = as_tuples(sync.staleness(wanted, newest, NOW), "coin", "needs_sync")
    assert state == [("EDGE", False), ("FRESH", False), ("NONE", True), ("OLD", True)]
    windows = sync.sync_windows(wanted, newest, NOW)
    assert as_tuples(windows, "coin", "sync_start", "sync_end") == [
        ("NONE", NOW - DAY_MS, NOW),
        ("OLD", DAY_1, NOW),
    ]


def test_increment_takes_the_windows_of_each_series(spark):
    source = frame(spark, hours(DAY_1, 48) + hours(DAY_1, 48, "ETH_USD"))
    windows = frame(spark, [candle(0, "btc/usd")]).select(
        *KEY, F.lit(DAY_1 + HOUR_MS).alias("sync_start"), F.lit(DAY_1 + 4 * HOUR_MS).alias("sync_end")
    )
    got = sync.increment(source, windows)
    assert as_tuples(got, "coin", TS) == [("BTC_USD", DAY_1 + n * HOUR_MS) for n in (1, 2, 3)]
    assert sync.increment(source, windows.limit(0)).isEmpty()


def test_sync_loads_once(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    source = frame(spark, hours(DAY_1, 30) + hours(DAY_1, 30, "ETH_USD"))
    wanted = frame(spark, [candle(0, "btc/usd"), candle(0, "ETH_USD"), candle(0, "XRP")])
    store.write(source.filter((F.col(TS) < DAY_1 + 10 * HOUR_MS) & (F.col("coin") == "BTC_USD")))
    for _ in range(2):
        sync.sync(store, source, wanted.select(*KEY), NOW)
        assert as_tuples(store.read_range().groupBy("coin").count(), "coin", "count") == [
            ("BTC_USD", 30),
            ("ETH_USD", 24),  # the default backfill is one day
        ]


def test_lookback_makes_old_series_count_as_empty(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    store.write(frame(spark, hours(DAY_1, 2)))
    wanted = frame(spark, [candle(0)]).select(*KEY)
    now = DAY_1 + 5 * DAY_MS
    assert sync.plan_sync(store, wanted, now).first().sync_start == DAY_1 + HOUR_MS
    assert sync.plan_sync(store, wanted, now, lookback_ms=DAY_MS).first().sync_start == now - DAY_MS


def test_read_through(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    source = frame(spark, hours(DAY_1, 30))
    wanted = source.select(*KEY).distinct()
    got = sync.read_through(
        store,
        source,
        wanted,
        NOW,
        SeriesKey(exchange="binance", coin="BTC/USD", interval="1h"),
        start=DAY_1 + 10 * HOUR_MS,
        paging=Paging(limit=3, offset=2),
    )
    assert stamps(got) == [DAY_1 + n * HOUR_MS for n in (12, 13, 14)]


def test_pages_of_one_timestamp_cover_every_row_once(spark):
    """More rows of one instant than any sort on the driver would hold."""
    rows = frame(spark, [])
    many = spark.range(12_000).select(
        *[F.lit(cell).alias(name) for name, cell in zip(rows.columns[:5], candle(DAY_1)[:5])],
        *[F.col("id").cast("double").alias(name) for name in rows.columns[5:]],
    )
    for pager in (paging.page, paging.page_of_one):
        seen = [row.open for n in range(2) for row in pager(many, Paging(6_000, 6_000 * n)).collect()]
        assert sorted(seen) == [float(n) for n in range(12_000)]
