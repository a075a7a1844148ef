from collections import Counter

from pyspark.sql import functions as F

from helpers import DAY_1, frame, hours, stamps
from wickstore import CandleStore
from wickstore.plans import frames
from wickstore.schema import DAY_MS, HOUR_MS, TS
from wickstore.session import cut_lineage
from wickstore.sources.pages import PAGE_SCHEMA
from wickstore.streaming import levels
from wickstore.streaming.ingest import (
    CandleBuilder,
    ingest_candles,
    ingest_pages,
    read_quarantine,
    stream_candles,
)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_ingest_keeps_late_rows_and_drops_repeats(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    landed = tmp_path / "landed"
    newest = frame(spark, hours(DAY_1 + 20 * DAY_MS, 5))
    oldest = frame(spark, hours(DAY_1, 5))
    for batch in (newest, oldest, newest.unionByName(oldest)):
        batch.coalesce(1).write.mode("append").parquet(str(landed))
    rows = stream_of(spark, landed, newest.schema)
    ingest_candles(rows, store, str(tmp_path / "progress")).awaitTermination()
    assert store.read_range().count() == 10

    # A restart from nothing sees every file again and adds no row.
    ingest_candles(rows, store, str(tmp_path / "progress-2")).awaitTermination()
    assert store.read_range().count() == 10


def test_watermark_removes_repeats_in_memory(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    rows = frame(spark, hours(DAY_1, 5) * 2)
    rows.coalesce(1).write.parquet(str(tmp_path / "landed"))
    stream = stream_of(spark, tmp_path / "landed", rows.schema)
    ingest_candles(
        stream, store, str(tmp_path / "progress"), watermark="2 hours"
    ).awaitTermination()
    assert store.read_range().count() == 5


def test_stream_candles_equal_batch_candles(spark, sf_dir, tmp_path):
    """Ticks of one candle arrive in different micro-batches."""
    ticks = frames.event_ticks(frames.table(spark, sf_dir, "events")).filter(
        F.col("micros") < (DAY_1 + 2 * DAY_MS) * 1000
    )
    landed = tmp_path / "landed"
    ticks.repartition(3).write.parquet(str(landed))
    store = CandleStore(spark, str(tmp_path / "store"))
    stream_candles(
        stream_of(spark, landed, ticks.schema),
        "1h",
        store,
        str(tmp_path / "progress"),
    ).awaitTermination()
    want = frames.candles(spark, sf_dir).filter(F.col(TS) < DAY_1 + 48 * HOUR_MS)
    got = store.read_latest_wins()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


# ------------------------------------------------------------------ quarantine


def page_rows(spark, rows):
    """Landed pages of four candles each, every value as text."""
    values = [[str(v) if v is not None else None for v in r[4:]] for r in rows]
    key = rows[0][:4]
    return spark.createDataFrame([(*key, values[n : n + 4]) for n in range(0, len(values), 4)], PAGE_SCHEMA)


def spoiled(rows):
    """Every 13th row bad, each in another way."""
    ways = [
        lambda r: (*r[:4], None, *r[5:]),
        lambda r: (*r[:4], "2024-01-01", *r[5:]),
        lambda r: (*r[:4], r[4] + 0.5, *r[5:]),
        lambda r: (*r[:8], "not-a-number", r[9]),
        lambda r: (*r[:8], None, r[9]),
        lambda r: (*r[:4], 10**18, *r[5:]),
    ]
    return [ways[n // 13 % len(ways)](r) if n % 13 == 0 else r for n, r in enumerate(rows)]


REASONS = ["missing: timestamp", "type: timestamp", "type: timestamp", "type: close", "missing: close", "range: timestamp"]


def test_bad_rows_go_to_quarantine_once(spark, tmp_path):
    rows = hours(DAY_1, 104)
    given = spoiled(rows)
    landed, progress = tmp_path / "landed", tmp_path / "progress"
    for n in range(0, 104, 26):
        page_rows(spark, given[n : n + 26]).coalesce(1).write.mode("append").json(str(landed))
    store = CandleStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", 1).json(str(landed))

    def check():
        assert stamps(store.read_range()) == [r[4] for n, r in enumerate(rows) if n % 13]
        bad = read_quarantine(spark, f"{progress}-quarantine").collect()
        assert sorted(r.reject_reason for r in bad) == sorted(REASONS[n % 6] for n in range(8))
        assert len(bad) == len({r.raw for r in bad}) == 8
        assert any("not-a-number" in r.raw for r in bad)

    ingest_pages(stream, store, str(progress)).awaitTermination()
    check()
    # The last batch is run again: its rows are there and its rejects replace themselves.
    for name in (progress / "commits").iterdir():
        if name.name.strip(".").startswith("3"):
            name.unlink()
    ingest_pages(stream, store, str(progress)).awaitTermination()
    check()


def test_empty_keys_and_fractions_for_whole_columns_are_rejected(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    store.write(frame(spark, hours(DAY_1, 1)).withColumn("trades", F.lit(3).cast("long")))
    rows = frame(spark, hours(DAY_1 + HOUR_MS, 4)).withColumn("trades", (F.col(TS) / HOUR_MS % 2 / 2).cast("double"))
    bad = rows.limit(1).withColumns({"coin": F.lit(" "), "trades": F.lit(1.0)})
    bad = bad.unionByName(bad.withColumn("coin", F.lit("A")).withColumn("data_type", F.lit(None).cast("string")))
    rows = rows.unionByName(bad)
    rows.coalesce(1).write.parquet(str(tmp_path / "landed"))
    progress = str(tmp_path / "progress")
    ingest_candles(stream_of(spark, tmp_path / "landed", rows.schema), store, progress).awaitTermination()
    found = sorted(r.reject_reason for r in read_quarantine(spark, f"{progress}-quarantine").collect())
    assert found == ["empty key", "missing key", "type: trades", "type: trades"]
    assert store.read_range().count() == 3


def test_rejects_pass_the_watermark(spark, tmp_path):
    store = CandleStore(spark, str(tmp_path / "store"))
    rows = frame(spark, hours(DAY_1, 5) * 2).select("*")
    text = rows.withColumn(TS, F.when(F.col("open") == 102.0, F.lit("soon")).otherwise(F.col(TS).cast("string")))
    text.coalesce(1).write.parquet(str(tmp_path / "landed"))
    progress = str(tmp_path / "progress")
    stream = stream_of(spark, tmp_path / "landed", text.schema)
    ingest_candles(stream, store, progress, watermark="2 hours").awaitTermination()
    assert store.read_range().count() == 4
    assert {r.reject_reason for r in read_quarantine(spark, f"{progress}-quarantine").collect()} == {"type: timestamp"}
    assert read_quarantine(spark, str(tmp_path / "nowhere")).isEmpty()


# ------------------------------------------------------------- levelled history


def test_runs_cover_all_batches_and_stay_few():
    for fan in (2, 3, 8):
        for batch in range(201):
            runs = levels.covering(batch, fan)
            held = [b for r in runs for b in range(r.number * fan**r.level, (r.number + 1) * fan**r.level)]
            assert held == list(range(batch))
            assert max(Counter(r.level for r in runs).values(), default=0) < fan
    assert max(len(levels.covering(b, 8)) for b in range(201)) <= 17
    assert levels.ending(7, 8) == [(1, 0)] and levels.ending(63, 8) == [(1, 7), (2, 0)]


def test_builder_reads_few_folders_and_counts_late_ticks(spark, sf_dir, tmp_path):
    """Ticks of two days in 12 batches, in no order of time; batches are applied twice here and there."""
    ticks = frames.event_ticks(frames.table(spark, sf_dir, "events")).filter(
        F.col("micros") < (DAY_1 + 2 * DAY_MS) * 1000
    )
    store = CandleStore(spark, str(tmp_path / "store"))
    builder = CandleBuilder(store, "1h", str(tmp_path / "partials"), fan=3)
    parts = cut_lineage(ticks.withColumn("part", F.pmod(F.xxhash64("tick_id"), F.lit(12))))
    most = 0
    for n in range(12):
        batch = parts.filter(F.col("part") == n).drop("part")
        for _ in range(2 if n in (2, 5, 8, 11) else 1):
            builder.apply(batch, n)
        most = max(most, len(list((tmp_path / "partials").glob("level=*/run=*"))))
    assert most <= 10
    builder.apply(parts.filter("part = 11").drop("part"), 11)
    want = frames.candles(spark, sf_dir).filter(F.col(TS) < DAY_1 + 48 * HOUR_MS)
    got = store.read_latest_wins()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    before = store.read_range().count()
    builder.apply(parts.filter("part = 11").drop("part"), 11)
    assert store.read_range().count() == before
    builder.apply(parts.limit(0).drop("part"), 12)
