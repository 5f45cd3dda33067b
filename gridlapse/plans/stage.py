"""Materialize a frame that several later jobs read.

A lazily chained frame is recomputed by each job that uses it, and so is everything below it after
an executor is lost. ``stage`` writes it once as Parquet to the cluster's shared checkpoint folder
and hands back a reader: lineage ends there, while column pruning and filters still reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def stage_directory(spark: SparkSession) -> str:
    """Folder named by the session; only a local session may fall back to one of its own."""
    context = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_CONF} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gridlapse-"))
    return context.getCheckpointDir()


#: Folder of the innermost :func:`staging` block.
_BLOCK: ContextVar[str | None] = ContextVar("staging", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """What is staged inside the block goes into one folder, which is deleted at its end.

    Write results before the block ends: frames that read staged data are of no use after it. Without
    such a block staged data stays until the owner of the checkpoint folder removes it.
    """
    path = f"{stage_directory(spark)}/staging-{uuid.uuid4().hex}"
    token = _BLOCK.set(path)
    try:
        yield path
    finally:
        _BLOCK.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in that of the innermost :func:`staging` block, or else in the shared one."""
    return f"{_BLOCK.get() or stage_directory(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
