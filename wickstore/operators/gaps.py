"""Time grids: what a series should hold, what is missing, gap ranges, fill, completeness.

The grid of a series runs from its first to its last timestamp in equal steps. Every operator
works on pieces of ``GRID_PIECE`` steps, so no task ever holds a whole series, however long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickstore.functions.keys import normalised
from wickstore.functions.epoch import floor_div
from wickstore.schema import KEY, TS

GRID_PIECE = 4096


def _grid_columns(ts: str, step: int) -> dict[str, Column]:
    """``phase`` (offset within a step), ``piece`` and ``slot`` (position within the piece)."""
    index = floor_div(F.col(ts), step)
    return {
        "phase": F.pmod(F.col(ts), F.lit(step)),
        "piece": floor_div(index, GRID_PIECE),
        "slot": F.pmod(index, F.lit(GRID_PIECE)).cast("int"),
    }


def _slot_to_ts(step: int) -> Column:
    return (F.col("piece") * GRID_PIECE + F.col("slot")) * step + F.col("phase")


def _bounds(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def _pieces(bounds: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """One row per series and grid piece between the bounds, with its slot range."""
    first = floor_div(F.col("first_ts"), step)
    last = first + floor_div(F.col("last_ts") - F.col("first_ts"), step)
    spans = bounds.filter(F.col("first_ts") <= F.col("last_ts")).select(
        *keys,
        F.pmod(F.col("first_ts"), F.lit(step)).alias("phase"),
        first.alias("_first"),
        last.alias("_last"),
    )
    pieces = spans.select(
        "*",
        F.explode(
            F.sequence(
                floor_div(F.col("_first"), GRID_PIECE), floor_div(F.col("_last"), GRID_PIECE)
            )
        ).alias("piece"),
    )
    base = F.col("piece") * GRID_PIECE
    return pieces.select(
        *keys,
        "phase",
        "piece",
        F.greatest(F.col("_first") - base, F.lit(0)).cast("int").alias("first_slot"),
        F.least(F.col("_last") - base, F.lit(GRID_PIECE - 1)).cast("int").alias("last_slot"),
    )


def _occupied(df: DataFrame, keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """The slots each piece holds: at most ``GRID_PIECE`` per row, copies merged map-side."""
    return (
        df.select(*keys, ts)
        .withColumns(_grid_columns(ts, step))
        .groupBy(*keys, "phase", "piece")
        .agg(F.collect_set("slot").alias("slots"))
    )


def expected_grid(
    df: DataFrame, step: int, keys: Sequence[str] = KEY, ts: str = TS
) -> DataFrame:
    """Every timestamp the series in ``df`` should hold."""
    pieces = _pieces(_bounds(df, keys, ts), keys, step)
    slots = pieces.withColumn("slot", F.explode(F.sequence("first_slot", "last_slot")))
    return slots.select(*keys, _slot_to_ts(step).alias(ts))


def _missing_slots(
    df: DataFrame, bounds: DataFrame, step: int, keys: Sequence[str], ts: str
) -> DataFrame:
    pieces = _pieces(bounds, keys, step)
    joined = pieces.join(_occupied(df, keys, ts, step), [*keys, "phase", "piece"], "left")
    return joined.withColumn(
        "missing",
        F.array_except(
            F.sequence("first_slot", "last_slot"),
            F.coalesce("slots", F.array().cast("array<int>")),
        ),
    )


def missing_timestamps(
    df: DataFrame,
    step: int,
    keys: Sequence[str] = KEY,
    ts: str = TS,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Grid timestamps without a row.

    ``bounds`` (``keys``, ``first_ts``, ``last_ts``) replaces the series' own first and last
    timestamps, and may name series that have no rows at all.
    """
    if bounds is None:
        bounds = _bounds(df, keys, ts)
    missing = _missing_slots(df, bounds, step, keys, ts)
    slots = missing.withColumn("slot", F.explode("missing"))
    return slots.select(*keys, _slot_to_ts(step).alias(ts))


def gap_ranges(df: DataFrame, step: int, keys: Sequence[str] = KEY, ts: str = TS) -> DataFrame:
    """Runs of missing timestamps as ``(gap_start, gap_end, n_missing)``, both ends missing.

    Neighbours are compared within a piece; along the whole series only the first and last slot
    of each piece are.
    """
    grid = _grid_columns(ts, step)
    slots = F.array_sort("slots")
    pairs = F.zip_with(
        slots,
        F.slice(slots, F.lit(2), F.size(slots)),
        lambda a, b: F.struct(a.alias("slot"), (b - a).alias("jump")),
    )
    inside = (
        _occupied(df, keys, ts, step)
        .select(*keys, "phase", "piece", F.filter(pairs, lambda p: p["jump"] > 1).alias("pairs"))
        .select(*keys, "phase", "piece", F.explode("pairs").alias("pair"))
        .select(*keys, "phase", "piece", "pair.*")
        .select(
            *keys,
            "phase",
            _slot_to_ts(step).alias("_last_seen"),
            (_slot_to_ts(step) + F.col("jump") * step).alias("_next_seen"),
        )
    )
    along = Window.partitionBy(*keys, "phase").orderBy("piece")
    between = (
        df.select(*keys, ts)
        .withColumns({"phase": grid["phase"], "piece": grid["piece"]})
        .groupBy(*keys, "phase", "piece")
        .agg(F.min(ts).alias("_head"), F.max(ts).alias("_last_seen"))
        .withColumn("_next_seen", F.lead("_head").over(along))
        .select(*inside.columns)
    )
    # Rows off the grid of their series (another phase) drop out here; the last row of a series
    # closes at the end of the grid.
    span = floor_div(F.col("last_ts") - F.col("first_ts"), step) * step
    grids = _bounds(df, keys, ts).select(
        *keys,
        F.pmod(F.col("first_ts"), F.lit(step)).alias("phase"),
        (F.col("first_ts") + span + step).alias("_grid_end"),
    )
    gaps = (
        inside.unionByName(between)
        .join(grids, [*keys, "phase"])
        .withColumn("_next_seen", F.coalesce("_next_seen", "_grid_end"))
        .filter(F.col("_next_seen") - F.col("_last_seen") > step)
    )
    return gaps.select(
        *keys,
        (F.col("_last_seen") + step).alias("gap_start"),
        (F.col("_next_seen") - step).alias("gap_end"),
        (floor_div(F.col("_next_seen") - F.col("_last_seen"), step) - 1).alias("n_missing"),
    )


def gap_fill(
    df: DataFrame, source: DataFrame, step: int, keys: Sequence[str] = KEY, ts: str = TS
) -> DataFrame:
    """Rows of ``source`` at timestamps ``df`` is missing, with normalised keys, ready to be appended."""
    missing = missing_timestamps(normalised(df, keys), step, keys, ts)
    return normalised(source, keys).join(missing, [*keys, ts], "left_semi")


def completeness(
    df: DataFrame, bounds: DataFrame, step: int, keys: Sequence[str] = KEY, ts: str = TS
) -> DataFrame:
    """Expected, present and missing grid points per series within closed ``bounds``.

    A series whose bounds hold no grid point expects none and is complete.
    """
    missing = _missing_slots(df, bounds, step, keys, ts)
    expected = F.col("last_slot") - F.col("first_slot") + 1
    counts = missing.groupBy(*keys).agg(
        F.sum(expected).cast("bigint").alias("n_expected"),
        F.sum(F.size("missing")).cast("bigint").alias("n_missing"),
    )
    counts = bounds.select(*keys).distinct().join(counts, list(keys), "left")
    counts = counts.fillna(0, ["n_expected", "n_missing"])
    return counts.select(
        *keys,
        "n_expected",
        (F.col("n_expected") - F.col("n_missing")).alias("n_present"),
        (F.col("n_missing") == 0).alias("is_complete"),
    )
