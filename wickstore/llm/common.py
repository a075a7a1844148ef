"""Tables of the pipeline, intermediate copies in the shared folder, and size-checked semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickstore.session import delete_path, scratch_path, session_setting

#: Ids that a broadcast may carry, about 16 bytes each; beyond it the join shuffles both sides.
MOST_BROADCAST_IDS = 500_000

_copies: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_copy(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, with its path; ``options`` go to the writer.

    A lost executor then costs no recomputation. The copy stays until ``drop_copy`` or ``drop_copies``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    _copies.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def settled_copy(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """As ``kept_copy``; the shuffle files of the work go when it is done, not when the driver collects garbage."""
    with session_setting(df, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return kept_copy(df, label, **options)


def small_batches(df: DataFrame):
    """Work on ``df`` inside the block passes 4 MB at a time to Python, not 64 MB; both sides hold whole batches."""
    return session_setting(df, "spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def drop_copy(spark: SparkSession, path: str) -> None:
    if path in _copies:
        _copies.remove(path)
    delete_path(spark, path)


def drop_copies(spark: SparkSession) -> None:
    """Delete the copies that earlier results were read from; call it when those results are used up."""
    while _copies:
        delete_path(spark, _copies.pop())


def rows_with(df: DataFrame, ids: DataFrame, column: str, count: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids``: a broadcast up to a checked number of ids, else a join."""
    return df.join(F.broadcast(ids) if count <= MOST_BROADCAST_IDS else ids, column, "left_semi")


def rows_without(df: DataFrame, ids: DataFrame, column: str, count: int) -> DataFrame:
    """As ``rows_with`` for the rows whose ``column`` is not in ``ids``, null among them."""
    return df.join(F.broadcast(ids) if count <= MOST_BROADCAST_IDS else ids, column, "left_anti")
