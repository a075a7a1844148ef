"""Stored counts, pages by them, walks by cursor, compaction, and what they read."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import DAY_1, as_tuples, candle, frame, hours, stamps
from wickstore import NO_DATE, YEAR_MONTH, CandleStore, SeriesKey
from wickstore.operators.paging import Paging
from wickstore.schema import DAY_MS, HOUR_MS, KEY, MINUTE_MS, TS
from wickstore.session import path_exists
from wickstore.sources import compaction, ledger

BTC = SeriesKey(exchange="binance", coin="BTC/USD", interval="1h")


@pytest.fixture
def store(spark, tmp_path):
    return CandleStore(spark, str(tmp_path / "store"))


def data_files(store):
    return sorted(p for p in Path(store.root).rglob("*.parquet") if not re.search("/_[a-z]", str(p)))


def files_read(df):
    """Data files that the executed plan opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan

    def scans(node):
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numFiles"):
            yield node.metrics().apply("numFiles").value()
        inner = node.plan() if node.nodeName().endswith("QueryStage") else None
        if inner is not None:
            yield from scans(inner)
        children = node.children()
        for n in range(children.length()):
            yield from scans(children.apply(n))

    return list(scans(plan))


def scans_of_data(df):
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().toString()
    conf.unset("spark.sql.maxMetadataStringLength")
    return [line for line in plan.splitlines() if "FileScan parquet" in line and "_ledger" not in line and "/cut-" not in line]


# ---------------------------------------------------------------------- ledger


def test_counts_follow_every_change(spark, store):
    def check():
        got = {(r.coin, r.day): r.n for r in store.ledger.counts().groupBy("coin", "day").agg(F.sum("n_rows").alias("n")).collect()}
        want = {(r.coin, r.day): r.n for r in store.scan().groupBy("coin", "day").agg(F.count("*").alias("n")).collect()}
        assert got == want and sum(got.values()) == store.read_range().count()

    check()
    store.write(frame(spark, hours(DAY_1, 60) + hours(DAY_1, 60, "ETH_USD")))
    check()
    store.append_new(frame(spark, hours(DAY_1 + DAY_MS, 40)))
    store.write(frame(spark, hours(DAY_1, 5)))
    check()
    store.write(frame(spark, hours(DAY_1 + 2 * DAY_MS, 10)), mode="overwrite")
    check()
    store.drop_series(frame(spark, [candle(0, "ETH_USD")]).select(*KEY))
    check()
    store.ledger.rebuild()
    check()


def test_a_file_is_counted_once(spark, store, monkeypatch):
    store.write(frame(spark, hours(DAY_1, 60)))
    counted = []
    plain = ledger.Ledger._counted
    monkeypatch.setattr(ledger.Ledger, "_counted", lambda self, new, named: counted.append(len(named)) or plain(self, new, named))
    store.inventory().collect()
    store.latest().collect()
    assert counted == [3]
    store.write(frame(spark, hours(DAY_1, 3)))
    store.latest().collect()
    assert counted == [3, 1]


def test_many_files_and_many_runs(spark, store, monkeypatch):
    monkeypatch.setattr(ledger, "MAX_NAMED", 3)
    monkeypatch.setattr(ledger, "MAX_RUNS", 2)
    for n in range(5):
        store.write(frame(spark, hours(DAY_1 + n * DAY_MS, 24 * 4)))
        assert store.inventory().first().n_rows == 96 * (n + 1)
    assert len(store.ledger._runs()) <= 3
    assert store.latest().first()[TS] == DAY_1 + 8 * DAY_MS - HOUR_MS


def test_catalog_opens_no_data_file(spark, store):
    store.write(frame(spark, hours(DAY_1, 30) + hours(DAY_1, 2, "ETH_USD")))
    store.inventory().collect()
    wanted = frame(spark, [candle(0, "btc/usd")]).select(*KEY)
    for df in (
        store.list_coins("binance"),
        store.series(),
        store.which_exist(wanted),
        store.inventory(),
        store.file_counts(),
        store.last_timestamps(),
        store.last_timestamps(store.series()),
    ):
        assert df.count() > 0 and not scans_of_data(df)
    sizes = {(r.coin, r.day): r.n_files for r in store.file_counts().collect()}
    assert sizes == {("BTC_USD", 1): 1, ("BTC_USD", 2): 1, ("ETH_USD", 1): 1}


def test_latest_opens_one_file_per_series(spark, store, monkeypatch):
    rows = hours(DAY_1, 24 * 20) + hours(DAY_1, 24 * 10, "ETH_USD") + hours(DAY_1, 1, "X%Y")
    store.write(frame(spark, rows), ingest_id=1)
    assert files_read(store.latest()) == [3]
    store.write(frame(spark, [candle(DAY_1 + 240 * HOUR_MS - HOUR_MS, "ETH_USD", 7.0)]), ingest_id=2)
    got = {r.coin: (r[TS], r.open) for r in store.latest().collect()}
    assert got == {
        "BTC_USD": (DAY_1 + 479 * HOUR_MS, 579.0),
        "ETH_USD": (DAY_1 + 239 * HOUR_MS, 7.0),
        "X%Y": (DAY_1, 100.0),
    }
    from wickstore.sources import store as module

    monkeypatch.setattr(module, "MAX_LISTED", 1)
    assert {r.coin: (r[TS], r.open) for r in store.latest().collect()} == got


# ------------------------------------------------------- touched partitions only


def test_append_reads_only_touched_partitions(spark, store):
    """Two rows years apart read two files of a store with one for each of 200 days."""
    days = [DAY_1 + n * DAY_MS for n in range(100)] + [DAY_1 + (3650 + n) * DAY_MS for n in range(100)]
    store.write(frame(spark, [candle(day) for day in days]))
    assert len(data_files(store)) == 200
    batch = store._prepare(frame(spark, [candle(days[3], value=1.0), candle(days[170])]), 5)
    near = store._scan_near(batch)
    assert files_read(near)[0] == 2
    assert "dynamicpruning" in near._jdf.queryExecution().optimizedPlan().toString().lower()
    store.append_new(frame(spark, [candle(days[3], value=1.0), candle(days[170]), candle(days[99] + DAY_MS)]))
    assert store.read_range().count() == 202
    assert store.read_latest_wins().filter(F.col(TS) == days[3]).first().open == 1.0


# ------------------------------------------------------------------------ pages


@pytest.mark.parametrize("layout", [None, YEAR_MONTH, NO_DATE])
def test_pages_by_stored_counts(spark, tmp_path, layout):
    store = CandleStore(spark, str(tmp_path / "s"), *([layout] if layout else []))
    rows = hours(DAY_1, 90) + hours(DAY_1, 31, "ETH_USD")
    store.write(frame(spark, rows), ingest_id=1)
    store.write(frame(spark, hours(DAY_1 + 10 * HOUR_MS, 30)), ingest_id=2)
    every = sorted((r[2], r[4]) for r in rows + hours(DAY_1 + 10 * HOUR_MS, 30))
    for paging in (Paging(7, 0), Paging(40, 5), Paging(1000, 100), Paging(5, 500), Paging(None, 20)):
        want = []
        for coin in ("BTC_USD", "ETH_USD"):
            own = [r for r in every if r[0] == coin]
            want += own[paging.offset :][: paging.limit]
        assert as_tuples(store.page(paging), "coin", TS) == want
    assert store.page(Paging(3), BTC).count() == 3
    assert store.page(Paging()).count() == 151


def test_page_reads_the_same_at_any_offset(spark, store):
    store.write(frame(spark, hours(DAY_1, 24 * 60)))
    store.inventory().collect()
    read = [max(files_read(store.page(Paging(24, offset)))) for offset in (0, 24 * 30, 24 * 59)]
    assert read == [1, 1, 1]


# ------------------------------------------------------------------------ walks


def test_walk_gives_the_snapshot_once_while_rows_arrive(spark, store):
    random.seed(1)
    first = hours(DAY_1, 100) + hours(DAY_1, 37, "ETH_USD")
    copies = [candle(DAY_1 + 20 * HOUR_MS, value=120.0)] * 9 + [candle(DAY_1 + 20 * HOUR_MS, value=float(n)) for n in range(6)]
    store.write(frame(spark, first + copies), ingest_id=10)
    bound, cursor, seen = store.snapshot(), None, []
    for n in range(30):
        page, cursor = store.next_page(11, bound, cursor)
        got = as_tuples(page)
        assert len({r[:3] for r in got}) <= 2
        if not got:
            break
        seen += page.collect()
        later = random.sample(range(100), 5)
        store.write(frame(spark, [candle(DAY_1 + h * HOUR_MS + MINUTE_MS * (n % 2)) for h in later]), ingest_id=11 + n)
    assert n == 11  # 115 rows by 11, and the empty page
    assert sorted(tuple(r)[:6] for r in seen) == sorted(r[:6] for r in first + copies)


def test_walk_of_an_empty_store(spark, store):
    page, cursor = store.next_page(10, store.snapshot())
    assert page.isEmpty() and cursor.isEmpty()


# ------------------------------------------------------------------- compaction


def test_fifty_appends_become_one_file_a_day(spark, store):
    rows = hours(DAY_1, 24 * 3)
    for n in range(50):
        store.write(frame(spark, rows[n::50]), ingest_id=n)
    store.write(frame(spark, rows[:5]), ingest_id=99)
    before, files = as_tuples(store.scan(), TS, "open", "ingest_id"), len(data_files(store))
    assert compaction.compact(store) == files
    assert len(data_files(store)) == 3
    assert as_tuples(store.scan(), TS, "open", "ingest_id") == before
    assert store.inventory().first().n_rows == len(before)
    assert compaction.compact(store) == 0
    assert not path_exists(spark, f"{store.root}/_compacting")


def crash_after(monkeypatch, name, calls):
    """Let the named step of a compaction fail at its n-th call."""
    plain, left = getattr(compaction, name), [calls]

    def failing(*args):
        if left[0] == 0:
            raise OSError("lost")
        left[0] -= 1
        return plain(*args)

    monkeypatch.setattr(compaction, name, failing)
    return lambda: monkeypatch.setattr(compaction, name, plain)


@pytest.mark.parametrize("step,calls", [("move_path", 0), ("move_path", 1), ("delete_path", 1), ("delete_path", 2)])
def test_compaction_that_was_cut_short_is_finished(spark, store, monkeypatch, step, calls):
    rows = hours(DAY_1, 24 * 2)
    for n in range(3):
        store.write(frame(spark, rows[n::3]))
    restore = crash_after(monkeypatch, step, calls)
    with pytest.raises(OSError):
        compaction.compact(store)
    restore()
    assert set(stamps(store.read_latest_wins())) == {r[4] for r in rows}
    store.write(frame(spark, hours(DAY_1 + 48 * HOUR_MS, 1)))
    assert compaction.compact(store) > 0
    assert stamps(store.read_range()) == [DAY_1 + n * HOUR_MS for n in range(49)]
    assert len(data_files(store)) == 3


def test_a_dropped_series_stays_dropped(spark, store, monkeypatch):
    for n in range(2):
        store.write(frame(spark, hours(DAY_1, 24, "ETH_USD")[n::2] + hours(DAY_1, 24)[n::2]))
    restore = crash_after(monkeypatch, "move_path", 0)
    with pytest.raises(OSError):
        compaction.compact(store)
    restore()
    store.drop_series(frame(spark, [candle(0, "ETH_USD")]).select(*KEY))
    compaction.compact(store)
    assert as_tuples(store.read_range(), "coin") == [("BTC_USD",)] * 24


def test_compaction_leaves_later_days_and_other_series(spark, store):
    import datetime as dt

    for n in range(2):
        store.write(frame(spark, hours(DAY_1, 72)[n::2] + hours(DAY_1, 72, "A=B")[n::2]))
    compaction.compact(store, SeriesKey(coin="A=B"), before=dt.datetime(2024, 1, 2))
    left = {(r.coin, r.day): r.n_files for r in store.file_counts().collect()}
    assert left == {(c, d): 1 if (c, d) == ("A=B", 1) else 2 for c in ("BTC_USD", "A=B") for d in (1, 2, 3)}
