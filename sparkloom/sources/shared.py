"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[str] = []  # folders of the scratch() blocks around, innermost last


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session in one process (local mode, as in tests) may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def folder_for(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or below that of the scratch() around."""
    return f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark) + '/sparkloom'}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and what was
    computed outlives lost executors."""
    spark = df.sparkSession
    path = folder_for(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Hadoop's file systems reach it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for everything that stored() writes within the block. It goes with the block, so results that
    outlive it must be written elsewhere first."""
    path = folder_for(spark, name)
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.pop()
        discard(spark, path)


@contextlib.contextmanager
def shuffled(spark: SparkSession, parts: int) -> Iterator[None]:
    """Shuffles of what runs within the block have parts partitions, none of them merged, if the session's number is smaller."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    if parts > int(before["spark.sql.shuffle.partitions"]):
        for k, v in zip(before, (str(parts), "false")):
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def few(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks a stored table of fixed-width columns for broadcast if it has max_rows rows at most; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
