"""Live candles: continuous ingest of landed rows and candles built from a tick stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType, TimestampNTZType, TimestampType

from wickstore.functions.epoch import floor_div, timestamp_to_ms
from wickstore.functions.keys import key_error
from wickstore.operators.filters import validate
from wickstore.schema import DAY_MS, KEY, KEY_FIELDS, TS
from wickstore.session import delete_path, materialised
from wickstore.sources.pages import raw_candles
from wickstore.sources.store import CandleStore
from wickstore.sources.ticks import combined_partials, finished_candles, partial_candles
from wickstore.streaming.levels import FAN, LevelledRuns

# First and last millisecond of the years 1 to 9999, which a timestamp can hold.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999
#: Days named one by one when the history of a batch is read; beyond this it is read whole.
MAX_DAYS = 1_000

QUARANTINE = StructType([*KEY_FIELDS]).add("raw", "string").add("reject_reason", "string").add("batch", "long")


def _start(writer, checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _key_problem() -> Column:
    kind = F.when(F.col("data_type").isNull(), "missing key").when(F.col("data_type") == "", "empty key")
    return F.coalesce(kind, key_error(F.col("exchange"), F.col("coin"), F.col("interval")))


def checked_rows(candles: DataFrame, store: CandleStore) -> DataFrame:
    """Typed rows with ``reject_reason`` (null for a row the store takes) and ``_raw``, the row as it came.

    Besides missing and mistyped values these are rejected: a key with an empty part, a time outside the years 1
    to 9999, and a fraction for a further column that the store holds as whole numbers.
    """
    absent = [name for name in KEY if name not in candles.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    rows = candles.withColumn("_raw", F.to_json(F.struct(*candles.columns)))
    if TS in rows.columns and isinstance(rows.schema[TS].dataType, (TimestampType, TimestampNTZType)):
        rows = rows.withColumn(TS, timestamp_to_ms(F.col(TS).cast("timestamp")))
    rows = validate(rows, store.record)
    out_of_range = ~F.col(TS).between(FIRST_MS, LAST_MS)
    reason = F.coalesce(
        _key_problem(),
        F.col("reject_reason"),
        F.when(out_of_range, F.lit(f"range: {TS}")),
        store.misfit(rows.drop("_raw", "reject_reason")),
    )
    return rows.withColumn("reject_reason", reason)


def ingest_candles(
    candles: DataFrame,
    store: CandleStore,
    checkpoint: str,
    watermark: str | None = None,
    trigger: dict | None = None,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Append each (series, timestamp) of a candle stream to ``store`` once, and again when it changes.

    Every micro-batch leaves out what the store already holds, so a replayed batch or a repeated
    candle adds nothing; a late or corrected one is kept. A row the store cannot take goes to the folder
    ``quarantine`` (beside the checkpoint by default) with its reason, and the stream goes on; a replayed batch
    replaces its own rejects, so each is there once. ``watermark`` adds a first, in-memory removal of
    repeats; it needs less store reading, but rows later than the watermark are then dropped. Rejects
    pass it by.
    """
    rejects = quarantine or f"{checkpoint.rstrip('/')}-quarantine"
    rows = checked_rows(candles, store)
    if watermark:
        # A reject is told apart by its text. Its time stays null, which never is too late and does not move
        # the watermark.
        valid = F.col("reject_reason").isNull()
        told_apart = {"_at": F.when(valid, F.timestamp_millis(F.col(TS))), "_bad": F.when(~valid, F.col("_raw"))}
        rows = (
            rows.withColumns(told_apart)
            .withWatermark("_at", watermark)
            .dropDuplicatesWithinWatermark([*KEY, TS, "_bad"])
            .drop("_at", "_bad")
        )

    def take(batch: DataFrame, batch_id: int) -> None:
        with materialised(batch, store.spark) as given:
            target = f"{rejects}/batch={batch_id}"
            bad = given.filter("reject_reason is not null")
            if bad.isEmpty():
                delete_path(store.spark, target)
            else:
                kept = bad.select(*KEY, F.col("_raw").alias("raw"), "reject_reason")
                kept.write.mode("overwrite").parquet(target)
            store.append_new(given.filter("reject_reason is null").drop("_raw", "reject_reason"))

    return _start(rows.writeStream.foreachBatch(take), checkpoint, trigger or {"availableNow": True})


def ingest_pages(pages: DataFrame, store: CandleStore, checkpoint: str, **options) -> StreamingQuery:
    """As ``ingest_candles`` for a stream of landed pages, with each page's candles as rows."""
    return ingest_candles(raw_candles(pages), store, checkpoint, **options)


def read_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected rows of a stream: key, the row as text, the reason, and the batch it came in."""
    try:
        found = spark.read.schema(QUARANTINE).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], QUARANTINE)
    return found.select(*QUARANTINE.fieldNames())


class CandleBuilder:
    """Builds candles of ``interval`` from batches of ticks and keeps ``store`` up to date.

    Each batch's partial candles are kept in levelled runs, so a batch reads a number of folders that grows
    with the logarithm of the batches before it, and ticks of any age count.
    """

    def __init__(
        self,
        store: CandleStore,
        interval: str,
        folder: str,
        keys: Sequence[str] = ("data_type", "exchange", "coin"),
        fan: int = FAN,
    ):
        self.store, self.interval, self.folder, self.keys, self.fan = store, interval, folder, keys, fan

    def apply(self, ticks: DataFrame, batch_id: int) -> None:
        """Take one batch; applying it again changes nothing."""
        keys, group = self.keys, [*self.keys, TS]
        # A micro-batch runs without adaptive execution, which the store's file layout relies on;
        # the rows move to the store's own session.
        partials = partial_candles(ticks, self.interval, keys=keys)
        with materialised(partials.withColumn("day", floor_div(F.col(TS), DAY_MS)), self.store.spark) as fresh:
            schema = StructType(fresh.schema.fields[:-1]).add("day", LongType())

            def merge(rows: DataFrame) -> DataFrame:
                return combined_partials(rows, keys).withColumn("day", floor_div(F.col(TS), DAY_MS))

            runs = LevelledRuns(self.store.spark, self.folder, schema, ["day"], merge, self.fan)
            landed = runs.add(batch_id, fresh)
            days = [row["day"] for row in fresh.select("day").distinct().limit(MAX_DAYS + 1).collect()]
            if days:
                if len(days) <= MAX_DAYS:
                    landed = landed.filter(F.col("day").isin(days))
                touched = landed.join(fresh.select(*group), group, "left_semi")
                candles = finished_candles(combined_partials(touched, keys), self.interval)
                self.store.append_new(candles)
            runs.settle(batch_id)


def stream_candles(
    ticks: DataFrame,
    interval: str,
    store: CandleStore,
    checkpoint: str,
    keys: Sequence[str] = ("data_type", "exchange", "coin"),
    partials: str | None = None,
    trigger: dict | None = None,
    fan: int = FAN,
) -> StreamingQuery:
    """Build candles of ``interval`` from a tick stream and keep ``store`` up to date.

    Each micro-batch lands its partial candles in the folder ``partials`` (beside the checkpoint
    by default, and tied to it) and merges those of the candles it touches, so ticks of any age count and no
    state is held. ``fan`` batches are merged into one run, ``fan`` runs into the next larger one. A replayed
    batch replaces its own partial candles. Open candles are written as they grow; a later version replaces an
    earlier one when the store is read with ``read_latest_wins``. ``ticks`` has the ``keys``, ``micros``,
    ``tick_id``, ``price``, ``size``.
    """
    builder = CandleBuilder(store, interval, partials or f"{checkpoint.rstrip('/')}-partials", keys, fan)
    return _start(ticks.writeStream.foreachBatch(builder.apply), checkpoint, trigger or {"availableNow": True})
