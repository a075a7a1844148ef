"""Runs of micro-batches in levels, so that a stream's history stays in few folders.

A run of level ``n`` holds ``fan ** n`` consecutive batches. The batches before any batch are covered by at most
``fan - 1`` runs of each level, which follow from its number alone: nothing is listed, and a batch that is
replayed reads and writes the same runs again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wickstore.session import delete_path

FAN = 8


class Run(NamedTuple):
    level: int
    number: int

    def parts(self, fan: int) -> list[Run]:
        """The runs one level below that this one replaces."""
        return [Run(self.level - 1, self.number * fan + n) for n in range(fan)]


def covering(batch: int, fan: int = FAN) -> list[Run]:
    """The runs that hold all batches before ``batch``."""
    found, first, level = [], 0, 0
    while fan ** (level + 1) <= batch:
        level += 1
    for n in range(level, -1, -1):
        size = fan**n
        while first + size <= batch:
            found.append(Run(n, first // size))
            first += size
    return found


def ending(batch: int, fan: int = FAN) -> list[Run]:
    """The runs above level 0 whose last batch is ``batch``, lowest level first."""
    found, level = [], 1
    while (batch + 1) % fan**level == 0:
        found.append(Run(level, (batch + 1) // fan**level - 1))
        level += 1
    return found


class LevelledRuns:
    """Rows of all batches so far under ``root``, merged level by level as batches arrive.

    ``merge`` combines the rows of several runs. ``columns`` partition each run.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: StructType,
        columns: list[str],
        merge: Callable[[DataFrame], DataFrame],
        fan: int = FAN,
    ):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.columns, self.merge, self.fan = columns, merge, fan

    def _path(self, run: Run) -> str:
        return f"{self.root}/level={run.level}/run={run.number}"

    def _read(self, runs: list[Run]) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("basePath", self.root)
        return reader.parquet(*map(self._path, runs)).select(*self.schema.fieldNames())

    def _write(self, rows: DataFrame, run: Run) -> None:
        laid_out = rows.select(*self.schema.fieldNames()).hint("rebalance", *self.columns)
        laid_out.write.mode("overwrite").partitionBy(*self.columns).parquet(self._path(run))

    def add(self, batch: int, rows: DataFrame) -> DataFrame:
        """Keep the rows of ``batch`` and return them with those of all earlier batches.

        Call ``settle`` when the result is used up. What earlier merges replaced is deleted here: the batches
        before this one are committed, so no replay needs it.
        """
        for run in ending(batch - 1, self.fan) if batch else []:
            for part in run.parts(self.fan):
                delete_path(self.spark, self._path(part))
        self._write(rows, Run(0, batch))
        return self._read([*covering(batch, self.fan), Run(0, batch)])

    def settle(self, batch: int) -> None:
        """Merge the runs that ``batch`` completes."""
        for run in ending(batch, self.fan):
            self._write(self.merge(self._read(run.parts(self.fan))), run)
