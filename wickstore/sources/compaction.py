"""Many small files of a partition rewritten as one, in steps that can be run again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore.schema import TS, SeriesKey
from wickstore.session import cut_lineage, delete_path, move_path, path_exists
from wickstore.sources.ledger import escaped
from wickstore.sources.store import CandleStore

#: Files up to this size are worth joining, and joined ones grow to about it.
FILE_BYTES = 128 << 20


def _small(store: CandleStore, key: SeriesKey | None, file_bytes: int) -> DataFrame:
    """The small files of each partition that has at least two of them."""
    columns = store.partition_columns
    files = store.ledger.files([store.folder(key)]).filter(store.key_filter(key)).filter(F.col("length") < file_bytes)
    several = files.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return cut_lineage(files.join(several, columns, "left_semi"))


def compact(
    store: CandleStore,
    key: SeriesKey | None = None,
    file_bytes: int = FILE_BYTES,
    before: dt.datetime | None = None,
) -> int:
    """Join the small files of each partition of the matching series; returns how many files were replaced.

    The rows of all files are written beside the store first, with the list of the files they come from. Then the
    new files are moved into their partitions, then the old ones deleted, one by one. A run that was cut
    short is taken up again by the next. Rows
    that are appended meanwhile are in files that are not on the list, and stay. While files are being
    exchanged a plain read may see rows twice; ``latest`` and ``read_latest_wins`` do not.

    ``before`` leaves partitions from that day on alone. The driver handles the names of the replaced files
    only; restrict ``key`` or ``before`` where they are too many.
    """
    staging = f"{store.root}/_compacting"
    replaced = _exchange(store, staging)
    small = _small(store, key, file_bytes)
    if before is not None:
        small = small.filter(store.starts_before(before))
    paths = [row.path for row in small.select("path").toLocalIterator()]
    if not paths:
        return replaced
    delete_path(store.spark, staging)
    small.select("path").write.parquet(f"{staging}/old")
    store.write_files(store.scan(*map(escaped, paths)), f"{staging}/new", "errorifexists")
    store.spark.createDataFrame([(len(paths),)], "n_old long").coalesce(1).write.parquet(f"{staging}/ready")
    return replaced + _exchange(store, staging)


def _exchange(store: CandleStore, staging: str) -> int:
    """Put the staged files in the place of those they come from, if a compaction got as far as that.

    Old files go only after all new ones are in place. So while a new file waits, the old ones of its
    partition must be there; if not, the series was overwritten or dropped since, and the file is void.
    """
    spark = store.spark
    if not path_exists(spark, f"{staging}/ready/_SUCCESS"):
        return 0
    old: dict[str, list[str]] = {}
    depth = len(store.partition_columns)
    for row in spark.read.parquet(f"{staging}/old").toLocalIterator():
        old.setdefault("/".join(row.path.split("/")[-depth - 1 : -1]), []).append(row.path)
    waiting = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{staging}/new")
    for row in waiting.select("path").filter("path like '%.parquet'").toLocalIterator():
        place = row.path.split("/")[-depth - 1 :]
        folder = "/".join(place[:-1])
        if not all(path_exists(spark, path) for path in old[folder]):
            old[folder] = []
        elif not move_path(spark, row.path, f"{store.root}/{folder}/{place[-1]}"):
            raise OSError(f"cannot move {row.path} into the store")
    replaced = sum(delete_path(spark, path) for paths in old.values() for path in paths)
    delete_path(spark, f"{staging}/ready")
    delete_path(spark, staging)
    return replaced
