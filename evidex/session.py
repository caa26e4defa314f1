"""Session helpers: local sessions for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Write options of Parquet for tables of whole texts: about two thirds of the default's size.
SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidex")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table of fewer files than cores, dealt to all cores by ``keys``.

    A file of one row group is one task, however many cores wait for it. Tables of more files are
    left as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, *keys)


_local_folder: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """Where written intermediate tables go: the shared folder in ``spark.checkpoint.dir``.

    Without the setting a local master uses one temporary folder per process, as in tests; on a
    cluster that would be a different folder on each machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="evidex-"))
        root = _local_folder[0]
    return f"{root.rstrip('/')}/evidex"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes a query's shuffle files when the query has ended.

    What was written stands in for them, so they need not stay until the driver collects garbage.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame once and go on from the written table.

    The table lies in the shared folder of ``work_folder``, so it outlives executors. Unlike an
    RDD checkpoint the table has columns and a size the planner can use.
    """
    return _written(df, f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str, **options: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``cut_lineage`` whose tables are smaller and deleted at the end, for frames that no one reads later."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    try:
        yield lambda df: _written(df, f"{folder}/{uuid.uuid4().hex}", **SMALL)
    finally:
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
