"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads).
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore import CandleStore, SeriesKey, build_session
from wickstore.operators import gaps, latest, paging, stats, sync
from wickstore.operators.paging import Paging
from wickstore.plans import frames
from wickstore.schema import DAY_MS, KEY, MINUTE_MS, TS
from wickstore.session import cut_lineage, scratch_path
from wickstore.sources.compaction import compact
from wickstore.streaming.ingest import ingest_candles

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
JAN_5, JAN_7 = 1704412800000, 1704585600000


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "wickstore-bench",
        master=f"local[{CPUS}]",
        spark_sql_shuffle_partitions=CPUS,
        spark_driver_memory="8g",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, work: Callable[[], object], repeats: int = 2) -> object:
        best, result = float("inf"), None
        for _ in range(repeats):
            began = time.perf_counter()
            result = work()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
        return result

    run(frames.candles(spark, SF_DIR, "1d"))
    timed("candles_1h", lambda: run(frames.candles(spark, SF_DIR, "1h")))
    timed("candles_1m", lambda: run(frames.candles(spark, SF_DIR, "1m")))

    hours = cut_lineage(frames.candles(spark, SF_DIR, "1h"))
    minutes = cut_lineage(frames.candles(spark, SF_DIR, "1m"))
    timed("missing_ts_1m", lambda: run(gaps.missing_timestamps(minutes, MINUTE_MS)))
    timed("gap_ranges_1m", lambda: run(gaps.gap_ranges(minutes, MINUTE_MS)))
    timed("coverage_1m", lambda: run(stats.coverage(minutes)))
    timed("latest_1m", lambda: run(latest.latest(minutes)))
    timed("page_small_offset", lambda: run(paging.page(minutes, Paging(100, 50))))
    timed("page_deep_offset", lambda: run(paging.page(minutes, Paging(100, 10_000))))
    timed("chunks_1m", lambda: run(paging.chunks(minutes, 1_000)))

    def fresh() -> CandleStore:
        return CandleStore(spark, scratch_path(spark, "bench"))

    timed("store_write", lambda: fresh().write(minutes), repeats=1)
    store = fresh()
    store.write(minutes)
    key = SeriesKey(exchange="synthetic", coin="CLICK", interval="1m")
    timed("range_all_series", lambda: run(store.read_range(None, JAN_5, JAN_7)))
    timed(
        "range_without_date_predicate",
        lambda: run(store.read_range(None, JAN_5, JAN_7, prune_dates=False)),
    )
    timed("range_one_series", lambda: run(store.read_range(key, JAN_5, JAN_7)))
    timed("store_inventory_first", lambda: run(store.inventory()), repeats=1)
    timed("store_inventory", lambda: run(store.inventory()))
    timed("store_latest", lambda: run(store.latest()))
    timed("store_list_coins", lambda: run(store.list_coins("synthetic")))
    timed("store_page_small_offset", lambda: run(store.page(Paging(100, 50))))
    timed("store_page_deep_offset", lambda: run(store.page(Paging(100, 10_000))))
    late = minutes.filter((F.col(TS) >= JAN_5) & (F.col(TS) < JAN_5 + DAY_MS // 24))
    late = cut_lineage(late.withColumn("close", F.col("close") + 1))
    timed("store_append_late", lambda: store.append_new(late), repeats=1)
    timed("store_compact", lambda: compact(store), repeats=1)
    one = minutes.filter("coin = 'CLICK'")
    timed("store_overwrite_series", lambda: store.write(one, mode="overwrite"), repeats=1)
    timed("store_drop_series", lambda: store.drop_series(one.select(*KEY).distinct()), repeats=1)

    landed = scratch_path(spark, "landed")
    hours.repartition(4).write.parquet(landed)

    def ingest() -> None:
        stream = spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        ingest_candles(stream, fresh(), scratch_path(spark, "progress")).awaitTermination()

    timed("stream_ingest_four_batches", ingest, repeats=1)

    span = hours.agg(F.min(TS).alias("lo"), F.max(TS).alias("hi")).first()
    cutoff = span.lo + (span.hi - span.lo) * 8 // 10
    synced = fresh()
    synced.write(hours.filter(F.col(TS) < cutoff))
    wanted = hours.select(*KEY).distinct()
    as_of = span.hi + DAY_MS // 24 + 1
    timed("sync_first", lambda: sync.sync(synced, hours, wanted, as_of), repeats=1)
    before = synced.read_range().count()
    timed("sync_second", lambda: sync.sync(synced, hours, wanted, as_of), repeats=1)
    if synced.read_range().count() != before or before != hours.count():
        raise SystemExit("sync is not idempotent")

    print(
        json.dumps(
            {
                "metric": "candle store queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
