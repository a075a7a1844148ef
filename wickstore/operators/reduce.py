"""Pick one whole row per group without collecting the group or sending it to one task."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ABOVE_LONG = Decimal(10**20)  # more than the range of a long
_LONG_SHIFT = Decimal(2**63)  # makes every long non-negative


def row_hash(columns: Sequence[str]) -> Column:
    """A 64-bit digest of the named columns."""
    return F.xxhash64(*[F.col(name) for name in columns])


def wide_key(major: Column, minor: Column) -> Column:
    """Two longs as one decimal that sorts by ``major`` (below 10**17), then ``minor``.

    A fixed-width key keeps ``min_by`` / ``max_by`` inside a hash aggregate; a struct key would
    make every task sort its input first.
    """
    high = major.cast("decimal(17,0)") * F.lit(_ABOVE_LONG)
    low = minor.cast("decimal(19,0)") + F.lit(_LONG_SHIFT)
    return (high + low).cast("decimal(38,0)")


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` values in each ``keys`` group; null sorts first.

    Equal rows are told apart by their other columns, so the choice does not depend on how the
    data is split. Partial aggregation leaves one row per group and task before the shuffle, so a
    group of any size is safe.
    """
    rest = [name for name in df.columns if name not in keys and name not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return top.select(*keys, "_row.*").select(*df.columns)
