"""The candle store: Parquet partitioned by series key and date.

Layout: ``root/data_type=../exchange=../coin=../interval=../year=../month=../day=../*.parquet``.
Column types live in the small append-only text folder ``root/_schema`` (Spark skips names that
start with an underscore), so reads never merge the footers of all files. ``root/_ledger`` keeps the row
counts and bounds of data files, ``root/_compacting`` the files of a compaction that has not ended.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import logging
import re
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    FloatType,
    IntegralType,
    LongType,
    NullType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from wickstore.functions.epoch import date_parts, ms_to_timestamp, timestamp_to_ms, to_ms
from wickstore.functions.keys import normalise
from wickstore.operators import paging
from wickstore.operators.filters import Condition, conditions_to_column
from wickstore.operators.paging import Paging
from wickstore.operators.reduce import top_row
from wickstore.schema import (
    DATE_FIELDS,
    INGEST,
    KEY,
    KEY_FIELDS,
    TS,
    YEAR_MONTH_DAY,
    PartitionLayout,
    SeriesKey,
    record_type,
)
from wickstore.session import (
    cut_lineage,
    delete_path,
    file_count,
    materialised,
    path_exists,
    session_setting,
)
from wickstore.sources.ledger import Ledger, escaped

logger = logging.getLogger(__name__)

# Values named one by one in a scan predicate; beyond this a wider predicate is used instead.
MAX_LISTED = 1_000
# Series folders opened one by one; beyond this the whole table is listed, in parallel.
MAX_FOLDERS = 100
_PLAIN = re.compile(r"[A-Za-z0-9_.\-]+")


class CandleStore:
    """All series of all exchanges in one partitioned table."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        layout: PartitionLayout = YEAR_MONTH_DAY,
        data_type: str = "ohlcv",
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.layout = layout
        self.record = record_type(data_type)
        self._known_fields: tuple[int, list[StructField]] = (0, self._base_fields())
        dates = [DATE_FIELDS[name] for name in layout.columns]
        self.ledger = Ledger(spark, self.root, [*KEY_FIELDS, *dates])

    # ------------------------------------------------------------------ schema

    @property
    def partition_columns(self) -> list[str]:
        return [*KEY, *self.layout.columns]

    def _base_fields(self) -> list[StructField]:
        fields = [
            StructField(TS, TimestampType(), True) if field.name == TS else field
            for field in self.record.schema.fields
        ]
        return [*fields, StructField(INGEST, LongType(), True)]

    def _stored_fields(self) -> list[StructField]:
        """Data columns written so far, in the order they first appeared.

        The schema folder is read again only when files were added to it.
        """
        folder = f"{self.root}/_schema"
        n_files = file_count(self.spark, folder)
        if self._known_fields[0] != n_files:
            rows = self.spark.read.schema("value string").text(folder).collect()
            versions = sorted((json.loads(row.value) for row in rows), key=lambda v: v["version"])
            fields = {field.name: field for field in self._base_fields()}
            for version in versions:
                for field in StructType.fromJson(version["schema"]).fields:
                    fields.setdefault(field.name, field)
            self._known_fields = (n_files, list(fields.values()))
        return self._known_fields[1]

    def schema(self) -> StructType:
        dates = [DATE_FIELDS[name] for name in self.layout.columns]
        return StructType([*self._stored_fields(), *KEY_FIELDS, *dates])

    def _record_schema(self, fields: list[StructField]) -> None:
        line = json.dumps({"version": time.time_ns(), "schema": StructType(fields).jsonValue()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode(
            "append"
        ).text(f"{self.root}/_schema")

    def _align(self, df: DataFrame) -> tuple[DataFrame, list[StructField]]:
        """Cast to the stored types and list the columns the store has not seen yet."""
        stored = {field.name: field.dataType for field in self._stored_fields()}
        columns, new = [], []
        for field in df.schema.fields:
            name = field.name
            if name in self.partition_columns:
                columns.append(F.col(name))
            elif name in stored:
                columns.append(_exact_cast(field, stored[name]).alias(name))
            else:
                kind = _storable(field)
                new.append(StructField(name, kind, True))
                columns.append(F.col(name).cast(kind).alias(name))
        return df.select(*columns), new

    def misfit(self, df: DataFrame) -> Column:
        """Why a row of ``df`` has no place in the stored columns, or null: a fraction for whole numbers."""
        stored = {field.name: field.dataType for field in self._stored_fields()}
        bad = [
            F.when(F.col(field.name) != F.floor(field.name), F.lit(f"type: {field.name}"))
            for field in df.schema.fields
            if isinstance(stored.get(field.name), IntegralType) and isinstance(field.dataType, (DoubleType, FloatType))
        ]
        return F.coalesce(*bad, F.lit(None).cast("string"))

    # ------------------------------------------------------------------- write

    def _prepare(self, df: DataFrame, ingest_id: int) -> DataFrame:
        """Normalise the key, turn milliseconds into timestamps and derive the date columns."""
        fields = {field.name: field.dataType for field in df.schema.fields}
        absent = [name for name in (*KEY, *self.record.required) if name not in fields]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        millis = F.col(TS) if isinstance(fields[TS], IntegralType) else timestamp_to_ms(F.col(TS))
        millis = F.coalesce(
            millis.cast("bigint"), F.raise_error(F.lit("timestamp is null")).cast("bigint")
        )
        keys = {
            name: F.coalesce(
                F.nullif(normalise(name, F.col(name)), F.lit("")),
                F.raise_error(F.lit(f"series key part {name} is empty")).cast("string"),
            )
            for name in KEY
        }
        parts = date_parts(F.col("_ms"))
        out = df.withColumn("_ms", millis).withColumns(keys)
        out = out.withColumns({name: parts[name] for name in self.layout.columns})
        if isinstance(fields[TS], IntegralType):
            out = out.withColumn(TS, ms_to_timestamp(F.col("_ms")))
        else:
            out = out.withColumn(TS, F.col(TS).cast("timestamp"))
        return out.drop("_ms").withColumn(INGEST, F.lit(ingest_id).cast("bigint"))

    def write(self, df: DataFrame, mode: str = "append", ingest_id: int | None = None) -> None:
        """Append rows, or with ``mode='overwrite'`` replace every series present in ``df``.

        An empty frame leaves the stored rows as they are.
        """
        if mode not in ("append", "overwrite"):
            raise ValueError(f"unknown mode: {mode!r}")
        self._store(self._prepare(df, _ingest_id(ingest_id)), mode)

    def append_new(self, df: DataFrame, ingest_id: int | None = None) -> None:
        """Append rows whose (series, timestamp) is not stored yet or was stored with other values.

        A changed row is a correction: ``read_latest_wins`` and ``latest`` return it. One row per
        timestamp is taken; running it again adds nothing. ``df`` is written to scratch first, as it is used several times and may come from this
        very store. Only its date range (and, if few, its series) is read from the store.
        """
        with materialised(self._prepare(df, _ingest_id(ingest_id)), self.spark) as rows:
            fresh = self._only_new(rows)
            if fresh is not None:
                self._store(fresh, "append")

    def _store(self, rows: DataFrame, mode: str) -> None:
        rows, new = self._align(rows)
        if new:
            self._record_schema(new)
        if mode == "overwrite":
            # Computed once: the list of written partitions must be that of the written rows.
            with materialised(rows, self.spark) as staged:
                self._replace_series(staged)
        else:
            self._save(rows, "append")

    def _save(self, rows: DataFrame, mode: str, **options: str) -> None:
        self.write_files(rows, self.root, mode, **options)

    def write_files(self, rows: DataFrame, folder: str, mode: str, **options: str) -> None:
        """Write rows in the store's layout: few files a partition, in time order."""
        # Rebalancing sends a partition to one task and splits hot partitions. Joining small
        # partitions is off: it would leave thousands of folders to one task. Time order inside
        # a file makes row-group statistics useful.
        columns = self.partition_columns
        laid_out = rows.hint("rebalance", *columns).sortWithinPartitions(*columns, TS)
        with session_setting(rows, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            laid_out.write.partitionBy(*columns).mode(mode).options(**options).parquet(folder)

    def _replace_series(self, rows: DataFrame) -> None:
        """Overwrite the partitions in ``rows``, then drop older ones of the same series.

        Running it again after a failure ends in the same state.
        """
        columns = self.partition_columns
        with materialised(rows.select(*columns).distinct()) as written:
            self._save(rows, "overwrite", partitionOverwriteMode="dynamic")
            if not self.layout.columns:
                return
            series = written.select(*KEY).distinct()
            stale = (
                self.ledger.files(self._paths_of(self._listed(series)))
                .select(*columns, _folder().alias("directory"))
                .distinct()
                .join(series, list(KEY), "left_semi")
                .join(written, columns, "left_anti")
            )
            self._delete(stale.select("directory"))

    def _only_new(self, rows: DataFrame) -> DataFrame | None:
        """Prepared rows that the store does not hold as they are, one per series and timestamp."""
        keys = [*KEY, TS]
        stored = self._scan_near(rows)
        if stored is None:
            return None
        known = {field.name: field.dataType for field in self._stored_fields()}
        compared = [c for c in rows.columns if c not in {*keys, *self.layout.columns, INGEST}]
        held = [name for name in compared if name in known]
        newest = top_row(stored.select(*keys, INGEST, *held), keys, [INGEST]).drop(INGEST)
        newest = newest.select(
            *keys, F.lit(True).alias("_held"), *[F.col(name).alias(f"_was_{name}") for name in held]
        )
        same = [F.col(name).cast(known[name]).eqNullSafe(F.col(f"_was_{name}")) for name in held]
        same += [F.col(name).isNull() for name in compared if name not in known]
        joined = top_row(rows, keys, [INGEST]).join(newest, keys, "left")
        return joined.filter(F.col("_held").isNull() | ~_all(same)).select(*rows.columns)

    def _scan_near(self, rows: DataFrame) -> DataFrame | None:
        """The stored rows of the partitions that ``rows`` touch; None for no rows.

        The partitions are a small table that the scan is joined with, so Spark prunes at run time to
        exactly these; the constant bounds serve when they are too many to be broadcast.
        """
        ms = timestamp_to_ms(F.col(TS))
        bounds = [F.min(ms).alias("lo"), F.max(ms).alias("hi")]
        columns = self.partition_columns
        touched = cut_lineage(rows.groupBy(*columns).agg(*bounds))
        listed = self._listed(touched)
        if not listed:
            return None
        span = touched.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        lo, hi = _as_datetime(span.lo), _as_datetime(span.hi)
        near = self._scan_listed(listed).filter(_instants(lo, hi) & self._dates_between(lo, hi))
        return self._within(near, touched)

    def _within(self, df: DataFrame, partitions: DataFrame, *further: str) -> DataFrame:
        """The rows of ``df``, a scan, in the given partitions, with ``further`` columns of theirs.

        The join is on one key made of all partition columns: pruning by each column alone would keep
        every combination of their values.
        """
        columns = self.partition_columns
        named = partitions.select(F.to_json(F.struct(*columns)).alias("_part"), *further)
        # Pruning at run time needs a side that has been filtered.
        named = named.filter(F.length("_part") > 0)
        rows = df.withColumn("_part", F.to_json(F.struct(*columns)))
        return rows.join(named, "_part", "inner" if further else "left_semi").drop("_part")

    # -------------------------------------------------------------------- read

    def scan(self, *paths: str) -> DataFrame:
        """The stored rows under ``paths`` (default: all) as written; absent paths hold no rows."""
        schema = self.schema()
        try:
            return (
                self.spark.read.schema(schema)
                .option("basePath", self.root)
                .parquet(*(paths or [self.root]))
            )
        except AnalysisException as error:
            if not _is_missing(error):
                raise
        return self._no_rows(schema)

    def _no_rows(self, schema: StructType) -> DataFrame:
        file = F.struct(F.lit(None).cast("string").alias("file_path"))
        return self.spark.createDataFrame([], schema).withColumn("_metadata", file)

    def _scan_listed(self, listed: Sequence[Row]) -> DataFrame:
        """Rows of a short list of series; of every series when the list is cut off.

        A few series are listed folder by folder, so planning does not walk the whole table.
        """
        if len(listed) > MAX_LISTED:
            return self.scan()
        wanted = _all(F.col(name).isin(sorted({row[name] for row in listed})) for name in KEY)
        paths = self._paths_of(listed)
        return self.scan(*paths).filter(wanted)

    def _paths_of(self, listed: Sequence[Row]) -> list[str]:
        """Folders that hold all files of the listed series, few enough to be listed one by one, else none."""
        paths = {self._series_path({name: row[name] for name in KEY}) for row in listed}
        if len(listed) > MAX_LISTED or len(paths) > MAX_FOLDERS:
            return []
        found = [path for path in sorted(paths) if path_exists(self.spark, path)]
        if not found:
            return sorted(paths)[:1]
        # A key that cannot be spelled as a folder stands for its parent, which may hold others.
        return [path for path in found if not any(path.startswith(f"{up}/") for up in found)]

    def key_filter(self, key: SeriesKey | None) -> Column:
        return _all(F.col(name) == value for name, value in (key.given() if key else {}).items())

    def folder(self, key: SeriesKey | None) -> str:
        return self._series_path(key.given() if key else {})

    def _files(self, key: SeriesKey | None) -> DataFrame:
        return self.ledger.files([self.folder(key)]).filter(self.key_filter(key))

    def _counts(self, key: SeriesKey | None) -> DataFrame:
        return self.ledger.counts([self.folder(key)], self.key_filter(key))

    def _scan_series(self, key: SeriesKey | None) -> DataFrame:
        return self.scan(self.folder(key)).filter(self.key_filter(key))

    def _series_path(self, given: Mapping[str, str]) -> str:
        """The deepest folder that holds every series with the given key parts.

        Listing one series instead of the whole table keeps planning time flat as the table grows.
        """
        path = self.root
        for name in KEY:
            value = given.get(name)
            if value is None or not _PLAIN.fullmatch(value):
                break
            path = f"{path}/{name}={value}"
        return path

    def _date(self) -> Column:
        """First day a partition covers."""
        return F.make_date("year", "month", "day" if "day" in self.layout.columns else F.lit(1))

    def starts_before(self, end: dt.datetime) -> Column:
        """Whether a partition begins before the day of ``end``; without dates every one does."""
        return self._date() < F.lit(end.date()) if self.layout.columns else F.lit(True)

    def _dates_between(self, lo: dt.datetime | None, hi: dt.datetime | None) -> Column:
        """The time range restated on the date columns, so whole partitions are skipped."""
        terms = []
        if self.layout.columns and lo is not None:
            first = lo.date() if "day" in self.layout.columns else lo.date().replace(day=1)
            terms.append(self._date() >= F.lit(first))
        if self.layout.columns and hi is not None:
            terms.append(self._date() <= F.lit(hi.date()))
        return _all(terms)

    def _scan_range(self, key, start, end, prune_dates: bool = True) -> DataFrame:
        df = self._scan_series(key)
        lo, hi = _as_datetime(start), _as_datetime(end)
        df = df.filter(_instants(lo, hi))
        return df.filter(self._dates_between(lo, hi)) if prune_dates else df

    def read_range(
        self,
        key: SeriesKey | None = None,
        start: int | dt.datetime | None = None,
        end: int | dt.datetime | None = None,
        columns: Sequence[str] | None = None,
        where: Sequence[Condition] = (),
        prune_dates: bool = True,
    ) -> DataFrame:
        """Rows with ``start <= timestamp <= end`` of the matching series; ``None`` is unbounded.

        ``timestamp`` comes back as epoch milliseconds. ``columns`` may leave out filter columns;
        by default it is the key, the record and extra columns.
        """
        start, end, where = _time_bounds(where, to_ms(start), to_ms(end))
        df = self._scan_range(key, start, end, prune_dates)
        if where:
            df = df.filter(conditions_to_column(where, {TS: timestamp_to_ms(F.col(TS))}))
        return _with_ms(df, columns or self._visible(df))

    def read_latest_wins(
        self,
        key: SeriesKey | None = None,
        start: int | dt.datetime | None = None,
        end: int | dt.datetime | None = None,
    ) -> DataFrame:
        """A range read with one row per series and timestamp: the one ingested last."""
        df = self._scan_range(key, start, end)
        rows = _with_ms(df, [*self._visible(df), INGEST])
        return top_row(rows, [*KEY, TS], [INGEST]).drop(INGEST)

    def _visible(self, df: DataFrame) -> list[str]:
        hidden = {*KEY, *self.layout.columns, INGEST, "_metadata"}
        return [*KEY, *[name for name in df.columns if name not in hidden]]

    @staticmethod
    def _listed(series: DataFrame) -> list[Row]:
        return series.select(*KEY).distinct().limit(MAX_LISTED + 1).collect()

    def latest(self, key: SeriesKey | None = None) -> DataFrame:
        """The newest row of every matching series over its full history.

        The ledger names the file that holds it, so one file of each series is opened, or several that hold
        equally new rows; of very many series, the partitions of those files.
        """
        group = Window.partitionBy(*KEY)
        newest = F.struct("last_at", "last_ingest")
        tops = self._counts(key).withColumn("_top", F.max(newest).over(group)).filter(newest == F.col("_top"))
        tops = cut_lineage(tops.select(*self.partition_columns, "path"))
        named = [row.path for row in tops.select("path").limit(MAX_LISTED + 1).collect()]
        if not named:
            df = self._no_rows(self.schema())
        elif len(named) <= MAX_LISTED:
            df = self.scan(*map(escaped, named))
        else:
            df = self._within(self._scan_series(key), tops.select(*self.partition_columns).distinct())
        rows = _with_ms(df, [*self._visible(df), INGEST])
        return top_row(rows, KEY, [TS, INGEST]).drop(INGEST)

    def last_timestamps(self, series: DataFrame | None = None) -> DataFrame:
        """``latest_ts`` of every stored series, or of those in ``series``; from the ledger alone."""
        if series is None:
            counts = self.ledger.counts()
        else:
            listed = self._listed(series)
            counts = self.ledger.counts(self._paths_of(listed) if listed else [])
            counts = counts.join(series.select(*KEY).distinct(), list(KEY), "left_semi")
        newest = counts.groupBy(*KEY).agg(F.max("last_at").alias("_last"))
        return newest.select(*KEY, timestamp_to_ms(F.col("_last")).alias("latest_ts"))

    # ------------------------------------------------------------------- pages

    def _bucket(self, ts: Column) -> Column:
        """The partition a time in milliseconds belongs to within its series, as a number that sorts by time."""
        parts = date_parts(ts)
        number = F.lit(0).cast("bigint")
        for name in self.layout.columns:
            number = number * 100 + parts[name]
        return number

    def _stored_bucket(self) -> Column:
        number = F.lit(0).cast("bigint")
        for name in self.layout.columns:
            number = number * 100 + F.col(name)
        return number

    def page(self, paging_: Paging, key: SeriesKey | None = None) -> DataFrame:
        """A page of every matching series by position in time order, copies and revisions included.

        The rows before a partition are summed from the stored counts, so only partitions that the page
        overlaps are opened, whatever its offset is.
        """
        if not paging_.has_pagination():
            return self.read_range(key)
        columns = self.partition_columns
        sizes = self._counts(key).groupBy(*columns).agg(
            F.sum("n_rows").alias("_size"),
            ((F.count(F.lit(1)) > 1) | (F.sum("n_times") < F.sum("n_rows"))).alias("_repeats"),
        )
        starts = paging.with_base(sizes.withColumn("_bucket", self._stored_bucket()), KEY)
        starts = cut_lineage(starts.filter(paging.overlaps(F.col("_base"), F.col("_size"), paging_)))
        df = self._within(self._scan_series(key), starts)
        rows = _with_ms(df, self._visible(df))
        return paging.page(rows, paging_, bucket=self._bucket, starts=starts.drop(*self.layout.columns))

    def snapshot(self, key: SeriesKey | None = None) -> int:
        """The newest ingest id stored, to which a walk is bound; -1 in an empty store."""
        newest = self._counts(key).agg(F.max("high_ingest")).first()[0]
        return -1 if newest is None else newest

    def next_page(
        self, size: int, snapshot: int, after: DataFrame | None = None, key: SeriesKey | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """The next ``size`` rows of every matching series behind the cursor ``after``, and the new cursor.

        Only rows up to ``snapshot`` count, so rows that arrive during a walk neither shift its pages nor
        enter them; each row of the snapshot comes once. From the stored counts only as many partitions
        behind the cursor are opened as surely hold ``size`` rows.
        """
        columns = self.partition_columns
        sure = F.when(F.col("high_ingest") <= snapshot, F.col("n_rows")).otherwise(0)
        sizes = (
            self._counts(key)
            .filter(F.col("low_ingest") <= snapshot)
            .groupBy(*columns)
            .agg(F.sum(sure).alias("_size"))
            .withColumn("_bucket", self._stored_bucket())
        )
        if after is not None:
            begun = after.select(*KEY, self._bucket(F.col("_at")).alias("_from"))
            sizes = sizes.join(begun, list(KEY), "left").filter("_from is null or _bucket >= _from")
            # Rows of the cursor's own partition may all lie before it.
            sizes = sizes.withColumn("_size", F.when(F.col("_bucket") == F.col("_from"), 0).otherwise(F.col("_size")))
        opened = cut_lineage(paging.with_base(sizes, KEY).filter(F.col("_base") < size).select(*columns))
        df = self._within(self._scan_series(key), opened).filter(F.col(INGEST) <= snapshot)
        rows = _with_ms(df, [*self._visible(df), INGEST])
        page, cursor = paging.seek(rows, size, after, bucket=self._bucket)
        return page.drop(INGEST), cursor

    # ----------------------------------------------------------------- catalog

    def series(self, key: SeriesKey | None = None) -> DataFrame:
        """The stored series keys, from the names of the files."""
        return self._files(key).select(*KEY).distinct()

    def list_coins(self, exchange: str, data_type: str = "ohlcv") -> DataFrame:
        key = SeriesKey(data_type=data_type, exchange=exchange)
        return self.series(key).select("coin").distinct().orderBy("coin")

    def exists(self, key: SeriesKey) -> bool:
        """Whether any row of the series is stored; ``interval=None`` means any interval."""
        return not self._files(key).isEmpty()

    def which_exist(self, requested: DataFrame) -> DataFrame:
        """``requested`` keys with a boolean ``is_stored``, for many series at once."""
        wanted = requested.withColumns({name: normalise(name, F.col(name)) for name in KEY})
        known = self.series().withColumn("is_stored", F.lit(True))
        return wanted.join(known, list(KEY), "left").withColumn(
            "is_stored", F.coalesce("is_stored", F.lit(False))
        )

    def inventory(self, key: SeriesKey | None = None) -> DataFrame:
        """Rows, time range and number of files per series; from the ledger alone."""
        return (
            self._counts(key)
            .groupBy(*KEY)
            .agg(
                F.sum("n_rows").alias("n_rows"),
                timestamp_to_ms(F.min("first_at")).alias("first_ts"),
                timestamp_to_ms(F.max("last_at")).alias("last_ts"),
                F.count(F.lit(1)).alias("n_files"),
            )
        )

    def file_counts(self, key: SeriesKey | None = None) -> DataFrame:
        """Files and bytes per partition, from the names of the files."""
        sizes = [F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")]
        return self._files(key).groupBy(*self.partition_columns).agg(*sizes)

    # -------------------------------------------------------------------- drop

    def drop_series(self, keys: DataFrame) -> int:
        """Delete the folders of the given series; series that are not stored are skipped."""
        wanted = keys.select(*[normalise(name, F.col(name)).alias(name) for name in KEY])
        folders = (
            self.ledger.files(self._paths_of(self._listed(wanted)))
            .select(*KEY, _folder(len(self.layout.columns)).alias("directory"))
            .distinct()
            .join(wanted, list(KEY), "left_semi")
            .select("directory")
        )
        dropped = self._delete(folders)
        if not dropped:
            logger.warning("no series to drop in %s", self.root)
        return dropped

    def _delete(self, directories: DataFrame) -> int:
        return sum(
            delete_path(self.spark, row.directory) for row in directories.toLocalIterator()
        )


def _all(terms: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, terms, F.lit(True))


def _time_bounds(
    where: Sequence[Condition], lo: int | None, hi: int | None
) -> tuple[int | None, int | None, list[Condition]]:
    """Closed time bounds that include the time conditions of ``where``, and its other conditions."""
    rest = []
    for name, op, value in where:
        if name != TS or op not in ("=", "==", "<", "<=", ">", ">=") or type(value) is not int:
            rest.append((name, op, value))
            continue
        if op in ("=", "==", ">", ">="):
            first = value + (op == ">")
            lo = first if lo is None else max(lo, first)
        if op in ("=", "==", "<", "<="):
            last = value - (op == "<")
            hi = last if hi is None else min(hi, last)
    return lo, hi, rest


def _with_ms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(
        *[timestamp_to_ms(F.col(TS)).alias(TS) if name == TS else F.col(name) for name in columns]
    )


def _folder(levels_up: int = 0) -> Column:
    """Folder of a listed file, or an ancestor of it."""
    return F.regexp_replace("path", f"(/[^/]+){{{levels_up + 1}}}$", "")


def _instants(lo: dt.datetime | None, hi: dt.datetime | None) -> Column:
    """Closed range on the stored timestamps, to the whole millisecond."""
    terms = [] if lo is None else [F.col(TS) >= F.lit(lo)]
    if hi is not None:
        terms.append(F.col(TS) < F.lit(hi + dt.timedelta(milliseconds=1)))
    return _all(terms)


def _ingest_id(given: int | None) -> int:
    return time.time_ns() // 1000 if given is None else given


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _storable(field: StructField):
    return StringType() if isinstance(field.dataType, NullType) else field.dataType


def _exact_cast(field: StructField, target) -> Column:
    """Cast to the stored type; a whole-number column refuses fractions."""
    col = F.col(field.name)
    if field.dataType == target:
        return col
    cast = col.cast(target)
    if isinstance(target, IntegralType) and isinstance(field.dataType, (DoubleType, FloatType)):
        message = F.lit(f"column {field.name} is stored as whole numbers")
        return F.when(cast.cast(field.dataType).eqNullSafe(col), cast).otherwise(
            F.raise_error(message).cast(target)
        )
    return cast


def _as_datetime(value: int | dt.datetime | None) -> dt.datetime | None:
    ms = to_ms(value)
    if ms is None:
        return None
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)
