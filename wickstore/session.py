"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_local_scratch: dict[str, str] = {}


def build_session(app: str = "wickstore", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution. Extra settings go in as ``spark_x_y='v'``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }
    settings.update({name.replace("_", "."): value for name, value in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_scratch.get("root")
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_scratch["root"] = tempfile.mkdtemp(prefix="wickstore-")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in ``spark`` if given.

    Later stages then neither repeat the work nor depend on executors staying alive.
    """
    return _write_and_read(df, spark or df.sparkSession)[0]


def _write_and_read(df: DataFrame, spark: SparkSession) -> tuple[DataFrame, str]:
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def materialised(df: DataFrame, spark: SparkSession | None = None) -> Iterator[DataFrame]:
    """As ``cut_lineage`` for work that ends inside the block; the copy is deleted afterwards."""
    spark = spark or df.sparkSession
    rows, path = _write_and_read(df, spark)
    try:
        yield rows
    finally:
        delete_path(spark, path)


def hadoop_path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def delete_path(spark: SparkSession, name: str) -> bool:
    """Remove a file or folder through the Hadoop file system; False if it was not there."""
    path = hadoop_path(spark, name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, name: str) -> bool:
    path = hadoop_path(spark, name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def move_path(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file into the folder of ``target``; False if it could not be."""
    path, to = hadoop_path(spark, source), hadoop_path(spark, target)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(to.getParent())
    return system.rename(path, to)


def file_count(spark: SparkSession, name: str) -> int:
    """Files below a small folder; 0 when it is not there."""
    if not path_exists(spark, name):
        return 0
    path = hadoop_path(spark, name)
    conf = spark._jsc.hadoopConfiguration()
    return path.getFileSystem(conf).getContentSummary(path).getFileCount()


@contextlib.contextmanager
def session_setting(df: DataFrame, name: str, value: str) -> Iterator[None]:
    """Run the enclosed action with one setting changed in the session of ``df``."""
    conf = df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, value)
    try:
        yield
    finally:
        conf.set(name, before)
