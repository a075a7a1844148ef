"""What the data files of a store hold, without opening them more than once.

Files are listed by a distributed job that reads names only. Row counts, time bounds and ingest ids of a file are
taken when it is first met and kept in the folder ``_ledger`` beside the data. An entry counts only while its file
is listed, so overwriting, dropping and compacting need no bookkeeping, and a lost ledger costs one read of the
data, never a row.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from wickstore.schema import INGEST, TS
from wickstore.session import cut_lineage, delete_path, hadoop_path, path_exists

# Files opened by name to be counted; beyond this they are picked out of a scan.
MAX_NAMED = 1_000
# Runs of entries from which they are written anew as one.
MAX_RUNS = 32

_FILE = StructType(
    [
        StructField("path", StringType()),
        StructField("modificationTime", TimestampType()),
        StructField("length", LongType()),
        StructField("content", BinaryType()),
    ]
)
_COUNTS = StructType(
    [
        StructField("file", StringType()),
        StructField("n_rows", LongType()),
        StructField("n_times", LongType()),
        StructField("first_at", TimestampType()),
        StructField("last_at", TimestampType()),
        StructField("last_ingest", LongType()),
        StructField("low_ingest", LongType()),
        StructField("high_ingest", LongType()),
    ]
)


class Ledger:
    """Names and counts of the data files below ``root``, which is partitioned by ``parts``."""

    def __init__(self, spark: SparkSession, root: str, parts: Sequence[StructField]):
        self.spark, self.root, self.folder = spark, root, f"{root}/_ledger"
        self.parts = list(parts)
        self.columns = [field.name for field in parts]

    def files(self, paths: Sequence[str] = ()) -> DataFrame:
        """Partition columns, ``file`` name, ``path`` and ``length`` of each data file; opens none."""
        schema = StructType([*_FILE.fields, *self.parts])
        reader = self.spark.read.format("binaryFile").schema(schema).option("basePath", self.root)
        wanted = [*self.columns, F.substring_index("path", "/", -1).alias("file"), "path", "length"]
        try:
            return reader.option("pathGlobFilter", "*.parquet").load(list(paths) or [self.root]).select(*wanted)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return self.spark.createDataFrame([], schema).withColumn("file", F.col("path")).select(*wanted)

    def _entries(self) -> DataFrame:
        schema = StructType([*self.parts, *_COUNTS.fields])
        if not path_exists(self.spark, self.folder):
            return self.spark.createDataFrame([], schema)
        # A file that two readers counted at once has two equal entries.
        return self.spark.read.schema(schema).parquet(self.folder).dropDuplicates([*self.columns, "file"])

    def counts(self, paths: Sequence[str] = (), where: Column | None = None) -> DataFrame:
        """One row per data file: rows, distinct times, time bounds, newest ingest id of its last time, ingest bounds.

        Files without an entry are counted here and remembered. ``where``, on partition columns, keeps entries of
        other series from being read.
        """
        where = F.lit(True) if where is None else where
        listed = cut_lineage(self.files(paths).filter(where))
        known = self._entries().filter(where)
        names = [*self.columns, "file"]
        new = listed.join(known.select(*names), names, "left_anti")
        some = new.select("path").limit(MAX_NAMED + 1).collect()
        if some:
            self._write(self._counted(new, [row.path for row in some]))
            known = self._entries().filter(where)
        return listed.join(known, names)

    def _counted(self, new: DataFrame, named: list[str]) -> DataFrame:
        schema = StructType([StructField(TS, TimestampType()), StructField(INGEST, LongType()), *self.parts])
        reader = self.spark.read.schema(schema).option("basePath", self.root)
        if len(named) <= MAX_NAMED:
            rows = reader.parquet(*map(escaped, named))
        else:
            rows = reader.parquet(self.root)
        # The name as the listing has it; names that Spark writes need no escapes.
        rows = rows.withColumn("file", F.col("_metadata.file_name"))
        names = [*self.columns, "file"]
        if len(named) > MAX_NAMED:
            rows = rows.join(new.select(*names), names, "left_semi")
        per_time = rows.groupBy(*names, TS).agg(
            F.count(F.lit(1)).alias("n"), F.max(INGEST).alias("high"), F.min(INGEST).alias("low")
        )
        return per_time.groupBy(*names).agg(
            F.sum("n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_times"),
            F.min(TS).alias("first_at"),
            F.max(TS).alias("last_at"),
            F.max_by("high", TS).alias("last_ingest"),
            F.min("low").alias("low_ingest"),
            F.max("high").alias("high_ingest"),
        )

    def _write(self, entries: DataFrame) -> None:
        entries.coalesce(8).write.parquet(f"{self.folder}/run={time.time_ns()}")
        if len(self._runs()) > MAX_RUNS:
            self.tidy()

    def _runs(self) -> list[str]:
        path = hadoop_path(self.spark, self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [status.getPath().toString() for status in system.listStatus(path)]

    def tidy(self) -> None:
        """Write the entries of all files that are still there as one run and delete the earlier runs."""
        runs = self._runs()
        names = [*self.columns, "file"]
        live = self._entries().join(self.files().select(*names), names, "left_semi")
        ordered = live.repartitionByRange(8, *self.columns).sortWithinPartitions(*self.columns)
        ordered.write.parquet(f"{self.folder}/run={time.time_ns()}")
        for run in runs:
            delete_path(self.spark, run)

    def rebuild(self, paths: Sequence[str] = ()) -> DataFrame:
        """Forget all entries and count the files of ``paths`` anew."""
        delete_path(self.spark, self.folder)
        return self.counts(paths)


def escaped(path: str) -> str:
    """A path whose characters are not read as a glob."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)
