"""Which series are stale, what to fetch for them, and loading it once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore.functions.epoch import interval_ms, to_ms
from wickstore.functions.keys import normalised
from wickstore.operators.paging import Paging, page
from wickstore.schema import DAY_MS, KEY, TS, SeriesKey
from wickstore.session import cut_lineage
from wickstore.sources.store import CandleStore


def staleness(requested: DataFrame, latest: DataFrame, as_of: int | dt.datetime) -> DataFrame:
    """``requested`` series with ``latest_ts`` and ``needs_sync``.

    A series needs a sync when it has no data or its newest row is more than one interval old.
    ``latest`` has the key and ``latest_ts``. Keys of both sides are normalised; an interval that
    has no length is an error.
    """
    now = to_ms(as_of)
    unknown = F.concat(F.lit("unknown interval: "), F.coalesce("interval", F.lit("null")))
    step = F.coalesce(interval_ms(F.col("interval")), F.raise_error(unknown).cast("bigint"))
    behind = F.col("latest_ts").isNull() | (F.lit(now) - F.col("latest_ts") > step)
    joined = normalised(requested).join(normalised(latest), list(KEY), "left")
    return joined.withColumn("needs_sync", behind)


def sync_windows(
    requested: DataFrame,
    latest: DataFrame,
    as_of: int | dt.datetime,
    backfill_ms: int = DAY_MS,
) -> DataFrame:
    """The half-open window to fetch per stale series, from its newest row to ``as_of``."""
    now = to_ms(as_of)
    start = F.coalesce(F.col("latest_ts"), F.lit(now - backfill_ms))
    return (
        staleness(requested, latest, as_of)
        .filter("needs_sync")
        .select(*KEY, start.alias("sync_start"), F.lit(now).alias("sync_end"))
    )


def increment(source: DataFrame, windows: DataFrame) -> DataFrame:
    """Source rows inside the sync window of their series, with normalised keys.

    The windows are computed once; their outer bounds go to the source scan as constants. Spark
    broadcasts them if they are small and splits hot series if they are not.
    """
    source = normalised(source)
    windows = cut_lineage(normalised(windows))
    found = windows.agg(
        F.count(F.lit(1)).alias("n"), F.min("sync_start").alias("lo"), F.max("sync_end").alias("hi")
    ).first()
    if not found.n:
        return source.limit(0)
    rows = source.filter((F.col(TS) >= found.lo) & (F.col(TS) < found.hi))
    inside = (F.col(TS) >= F.col("sync_start")) & (F.col(TS) < F.col("sync_end"))
    joined = rows.join(windows, list(KEY)).filter(inside)
    return joined.select(*source.columns)


def plan_sync(
    store: CandleStore,
    requested: DataFrame,
    as_of: int | dt.datetime,
    lookback_ms: int | None = None,
    backfill_ms: int = DAY_MS,
) -> DataFrame:
    """Sync windows of the requested series against what the store holds.

    ``lookback_ms`` limits how far back a newest row is looked for; a series without one in that
    span counts as empty.
    """
    wanted = normalised(requested).select(*KEY).distinct()
    if lookback_ms is None:
        newest = store.last_timestamps(wanted)
    else:
        now = to_ms(as_of)
        newest = (
            store.read_range(None, now - lookback_ms, now, columns=[*KEY, TS])
            .groupBy(*KEY)
            .agg(F.max(TS).alias("latest_ts"))
        )
    return sync_windows(wanted, newest, as_of, backfill_ms)


def sync(
    store: CandleStore,
    source: DataFrame,
    requested: DataFrame,
    as_of: int | dt.datetime,
    lookback_ms: int | None = None,
    backfill_ms: int = DAY_MS,
) -> None:
    """Load what is new for every stale series in one job; running it again adds nothing."""
    windows = plan_sync(store, requested, as_of, lookback_ms, backfill_ms)
    store.append_new(increment(source, windows))


def read_through(
    store: CandleStore,
    source: DataFrame,
    requested: DataFrame,
    as_of: int | dt.datetime,
    key: SeriesKey | None = None,
    start: int | dt.datetime | None = None,
    end: int | dt.datetime | None = None,
    paging: Paging | None = None,
    backfill_ms: int = DAY_MS,
) -> DataFrame:
    """Sync the requested series, then read a range of the store, page by page if asked."""
    sync(store, source, requested, as_of, backfill_ms=backfill_ms)
    return page(store.read_latest_wins(key, start, end), paging)
