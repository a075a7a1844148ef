"""Pages and chunks of every series at once, by exact position in time order.

Positions come from row counts per (series, time bucket), which are tiny, and a numbering inside
each bucket. No task sorts a whole series, and a page only numbers the buckets it overlaps. Buckets whose times
do not repeat are numbered by time alone; only the others need an order among rows of one time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickstore.functions.epoch import floor_div
from wickstore.operators.reduce import row_hash
from wickstore.schema import DAY_MS, KEY, TS
from wickstore.session import cut_lineage

_COPIES_PER_STEP = 10_000

Bucket = Callable[[Column], Column]


@dataclass(frozen=True)
class Paging:
    limit: int | None = None
    offset: int = 0

    @classmethod
    def all_records(cls) -> Paging:
        return cls()

    def has_pagination(self) -> bool:
        return self.limit is not None or self.offset > 0


def by_day(ts: Column) -> Column:
    return floor_div(ts, DAY_MS)


def with_base(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_base``, the rows of the same series in earlier buckets, to counts ``_size`` per ``_bucket``."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def overlaps(base: Column, size: Column, paging: Paging) -> Column:
    inside = base + size > paging.offset
    if paging.limit is not None:
        inside = inside & (base < paging.offset + paging.limit)
    return inside


def _bucket_starts(df: DataFrame, keys: Sequence[str], ts: str, bucket: Bucket, unique: bool) -> DataFrame:
    """Rows per (series, bucket), whether times repeat in it, and the position of its first row."""
    if unique:
        counts = df.groupBy(*keys, bucket(F.col(ts)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
        return with_base(counts.withColumn("_repeats", F.lit(False)), keys)
    times = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    counts = times.groupBy(*keys, bucket(F.col(ts)).alias("_bucket")).agg(
        F.sum("_n").alias("_size"), (F.max("_n") > 1).alias("_repeats")
    )
    return with_base(counts, keys)


def with_position(
    df: DataFrame,
    paging: Paging | None = None,
    keys: Sequence[str] = KEY,
    ts: str = TS,
    unique: bool = False,
    bucket: Bucket = by_day,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Adds ``position``, the zero-based place of a row in its series by time.

    With ``paging`` only the rows of that page come back. ``unique`` promises one row per series
    and timestamp, which saves counting them; otherwise rows of one timestamp are ordered by a digest of the row, and
    copies of a row are counted before they are shuffled. ``starts`` gives ``_size``, ``_repeats`` and ``_base`` of
    each ``_bucket`` where they are known; otherwise one pass counts them.
    """
    paging = paging or Paging.all_records()
    if starts is None:
        starts = cut_lineage(_bucket_starts(df, keys, ts, bucket, unique))
    starts = starts.filter(overlaps(F.col("_base"), F.col("_size"), paging))
    plain, repeating = starts.filter("not _repeats"), starts.filter("_repeats")
    if unique or repeating.isEmpty():
        numbered = _number_unique(df, plain, keys, ts, bucket)
    elif plain.isEmpty():
        numbered = _number_any(df, repeating, keys, ts, bucket, paging)
    else:
        numbered = _number_unique(df, plain, keys, ts, bucket).unionByName(
            _number_any(df, repeating, keys, ts, bucket, paging)
        )
    wanted = F.col("position") >= paging.offset
    if paging.limit is not None:
        wanted = wanted & (F.col("position") < paging.offset + paging.limit)
    return numbered.filter(wanted)


def _number_unique(df: DataFrame, starts: DataFrame, keys: Sequence[str], ts: str, bucket: Bucket) -> DataFrame:
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    known = starts.select(*keys, "_bucket", "_base")
    rows = df.withColumn("_bucket", bucket(F.col(ts))).join(known, [*keys, "_bucket"])
    position = F.col("_base") + F.row_number().over(inside) - 1
    return rows.withColumn("position", position).select(*df.columns, "position")


def _place(columns: Sequence[str]) -> tuple[Column, Column]:
    """What orders rows of one time: one of 64 ranges of their digest, and the digest."""
    digest = row_hash(columns)
    return F.shiftrightunsigned(digest, 58), digest


def _number_any(
    df: DataFrame, starts: DataFrame, keys: Sequence[str], ts: str, bucket: Bucket, paging: Paging
) -> DataFrame:
    columns = df.columns
    slot, digest = _place(columns)
    group = [*keys, ts, "_slot"]
    # Only rows of the buckets at hand take part in what follows.
    bucketed = df.withColumn("_bucket", bucket(F.col(ts)))
    df = bucketed.join(starts.select(*keys, "_bucket"), [*keys, "_bucket"], "left_semi").select(*columns)

    # Rows of one timestamp are spread over up to 64 digest ranges; each range gets its start.
    sizes = (
        df.withColumn("_slot", slot)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", bucket(F.col(ts)))
    )
    earlier = Window.partitionBy(*keys, "_bucket").orderBy(ts, "_slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    group_starts = (
        sizes.join(starts.select(*keys, "_bucket", "_base"), [*keys, "_bucket"])
        .withColumn("_start", F.col("_base") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter(overlaps(F.col("_start"), F.col("_n"), paging))
        .select(*group, "_start")
    )

    distinct_rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    smaller = (
        Window.partitionBy(*group)
        .orderBy("_digest", *columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        distinct_rows.withColumn("_digest", digest)
        .withColumn("_slot", slot)
        .join(group_starts, group)
        .withColumn("_start", F.col("_start") + F.coalesce(F.sum("_copies").over(smaller), F.lit(0)))
    )
    return _expand_copies(placed, paging).select(*columns, "position")


def _expand_copies(placed: DataFrame, paging: Paging) -> DataFrame:
    """Turns counted copies back into rows, in steps so that no array grows with the count."""
    first = F.greatest(F.col("_start"), F.lit(paging.offset))
    last = F.col("_start") + F.col("_copies") - 1
    if paging.limit is not None:
        last = F.least(last, F.lit(paging.offset + paging.limit - 1))
    steps = placed.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    steps = steps.withColumn(
        "_step", F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(_COPIES_PER_STEP)))
    )
    step_end = F.least(F.col("_last"), F.col("_step") + _COPIES_PER_STEP - 1)
    return steps.withColumn("position", F.explode(F.sequence(F.col("_step"), step_end)))


def page(
    df: DataFrame,
    paging: Paging | None = None,
    keys: Sequence[str] = KEY,
    ts: str = TS,
    unique: bool = False,
    bucket: Bucket = by_day,
    starts: DataFrame | None = None,
) -> DataFrame:
    """The page of every series; an offset past the end gives no rows for that series."""
    if paging is None or not paging.has_pagination():
        return df
    return with_position(df, paging, keys, ts, unique, bucket, starts).drop("position")


def page_of_one(
    df: DataFrame,
    paging: Paging | None = None,
    keys: Sequence[str] = KEY,
    ts: str = TS,
    unique: bool = False,
) -> DataFrame:
    """The page of a frame that holds a single series, in the order of its positions."""
    if paging is None or not paging.has_pagination():
        return df
    return with_position(df, paging, keys, ts, unique).orderBy("position").drop("position")


def seek(
    df: DataFrame,
    size: int,
    after: DataFrame | None = None,
    keys: Sequence[str] = KEY,
    ts: str = TS,
    bucket: Bucket = by_day,
) -> tuple[DataFrame, DataFrame]:
    """The first ``size`` rows of every series behind the cursor ``after``, and the cursor behind these.

    Rows are ordered by time, then by a digest of the row. A cursor names the last row given of each series:
    its time ``_at``, its digest (``_slot``, ``_digest``), and how many copies of it were ``_taken``. Unlike an
    offset it does not move when rows are added elsewhere. A series that is not in ``after`` starts at its first row.
    """
    columns = df.columns
    slot, digest = _place(columns)
    rows = df
    if after is not None:
        here = F.struct(F.col(ts), F.col("_own_slot"), F.col("_own_digest"))
        last = F.struct("_at", "_slot", "_digest")
        marked = df.withColumns({"_own_slot": slot, "_own_digest": digest}).join(after, list(keys), "left")
        behind = marked.filter(F.col("_at").isNull() | (here > last)).select(*columns)
        # Copies of the cursor's own row that are still to come; one row per series before the copies are made.
        same = marked.filter(here == last).groupBy(*columns, "_taken").agg(F.count(F.lit(1)).alias("_copies"))
        steps = F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(_COPIES_PER_STEP))
        rest = (
            same.withColumn("_copies", F.least(F.col("_copies") - F.col("_taken"), F.lit(size)))
            .filter("_copies > 0")
            .withColumn("_step", F.explode(steps))
            .withColumn("_n", F.least(F.col("_copies") - F.col("_step"), F.lit(_COPIES_PER_STEP)).cast("int"))
            .select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy"))
        )
        rows = behind.unionByName(rest.drop("_copy"))
    rows = cut_lineage(with_position(rows, Paging(size), keys, ts, bucket=bucket).drop("position"))
    marks = rows.select(*keys, F.col(ts).alias("_at"), slot.alias("_slot"), digest.alias("_digest"))
    counted = marks.groupBy(*marks.columns).agg(F.count(F.lit(1)).alias("_taken"))
    mark = ["_at", "_slot", "_digest"]
    known = counted if after is None else counted.unionByName(after.select(*counted.columns))
    # A cursor inside the copies of a row has taken those of this page and of the pages before.
    summed = known.groupBy(*keys, *mark).agg(F.sum("_taken").alias("_taken"))
    top = summed.groupBy(*keys).agg(F.max(F.struct(*mark, "_taken")).alias("_top"))
    return rows, cut_lineage(top.select(*keys, "_top.*"))


def chunks(
    df: DataFrame,
    size: int,
    keys: Sequence[str] = KEY,
    ts: str = TS,
    unique: bool = False,
) -> DataFrame:
    """Adds ``chunk_id``: consecutive groups of ``size`` rows per series, for chunked delivery."""
    placed = with_position(df, None, keys, ts, unique)
    return placed.withColumn("chunk_id", floor_div(F.col("position"), size)).drop("position")


def write_chunks(chunked: DataFrame, path: str, keys: Sequence[str] = KEY) -> None:
    """One folder per series and chunk."""
    parts = [*keys, "chunk_id"]
    chunked.repartition(*parts).write.partitionBy(*parts).parquet(path)


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = (*KEY, TS)) -> DataFrame:
    """One row: how many keys two pages share. Disjoint pages share none."""
    shared = a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("n_shared"))
