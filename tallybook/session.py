"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; the warehouse where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


#: Spark's own setting: shuffle files of a command go when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of writes in here are removed as each write ends; nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder, so later passes do not recompute it.

    As Parquet: columns are compressed, and later passes read only those they need. An RDD
    checkpoint writes and reads whole rows as they are in memory.
    """
    return _store(df)[0]


@contextmanager
def passing_copy(df: DataFrame) -> Iterator[DataFrame]:
    """``reliable_checkpoint`` that is deleted on leaving: for passes that all run before that."""
    copy, folder = _store(df)
    try:
        yield copy
    finally:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
