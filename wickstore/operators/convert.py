"""Handing a bounded page of rows to pandas or Arrow."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from wickstore.schema import TS

MAX_EDGE_ROWS = 100_000


def _bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` itself, refused when it is too large for one machine."""
    if not df.offset(max_rows).limit(1).isEmpty():
        raise ValueError(f"more than {max_rows} rows; page the frame or stay on Spark")
    return df


def to_pandas(df: DataFrame, max_rows: int = MAX_EDGE_ROWS) -> pd.DataFrame:
    """Pandas frame; whole-number ``timestamp`` values become UTC timestamps."""
    whole = TS in df.columns and isinstance(df.schema[TS].dataType, IntegralType)
    out = _bounded(df, max_rows).toPandas()
    if whole:
        out[TS] = pd.to_datetime(out[TS], unit="ms", utc=True)
    return out


def to_arrow(df: DataFrame, max_rows: int = MAX_EDGE_ROWS) -> pa.Table:
    """Arrow table; ``timestamp`` is ``timestamp[ms, UTC]``."""
    table = _bounded(df, max_rows).toArrow()
    if TS in table.column_names:
        at = table.column_names.index(TS)
        column = table.column(TS)
        if pa.types.is_integer(column.type):
            column = column.cast(pa.int64())
        kind = pa.timestamp("ms", tz="UTC")
        table = table.set_column(at, pa.field(TS, kind), column.cast(kind))
    return table


def convert(df: DataFrame, form: str, max_rows: int = MAX_EDGE_ROWS):
    """``form`` is ``spark``, ``pandas`` or ``arrow``."""
    if form == "spark":
        return df
    if form == "pandas":
        return to_pandas(df, max_rows)
    if form == "arrow":
        return to_arrow(df, max_rows)
    raise ValueError(f"unsupported form: {form!r}")
