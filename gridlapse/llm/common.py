"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.plans.stage import fresh_path, stage

#: One word: a run without the ASCII white space space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "fresh_folder", "output_name", "split_listed", "stage", "store", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder, with the scheme that Hadoop gives it, so that files of tasks and Spark's go to one place.

    A folder named without a scheme is where Hadoop's default says. On a cluster that must not be a disk of each
    machine's own: tasks write small files to a folder beside it, and unless all of them are seen here it is refused.
    One that is named with ``file:`` is taken as mounted everywhere.
    """
    path = fresh_path(spark, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    if whole.startswith("file:") and not path.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        refused = f"{path} is on a local disk; name a shared folder with its scheme in spark.checkpoint.dir"
        try:
            seen = seen_from_tasks(spark, f"{whole}-probe")
        except Exception as error:
            raise ValueError(refused) from error
        if not seen:
            raise ValueError(refused)
    return whole


def seen_from_tasks(spark: SparkSession, folder: str) -> bool:
    """Whether files that tasks write to a new folder are all in it from here, too; the folder is deleted again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        system.create_dir(path, recursive=True)
        for _ in batches:
            name = output_name("probe")
            system.open_output_stream(f"{path}/{name}").close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    names = {row.name for row in spark.range(0, tasks, 1, tasks).mapInArrow(write, "name string").collect()}
    system, path = store(folder)
    here = {info.base_name for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=True))}
    if here:
        system.delete_dir(path)
    return names <= here


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, for tasks that read or write files of their own format."""
    if uri.startswith(("/", "file:")):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def output_name(prefix: str) -> str:
    """A file name that no other attempt of the task uses; only names that a finished attempt reports count."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{prefix}-{part:06d}-{uuid.uuid4().hex}"


#: Words of 64 bits that mark the values of a list, at most: 2 MB of marks, some 12 MB as a table in each executor.
MARK_WORDS = 1 << 18


def split_listed(rows: DataFrame, own: Column, listed: DataFrame, entry: Column) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``own`` may be among the values ``entry`` of ``listed``, and those whose ``own`` surely isn't.

    A join with a list that is too long for all tasks moves every row, whole texts too. Here each value of the list
    sets one of 16 bits for each value, and the bits go to all tasks, so that only the first part has to be
    joined. It holds all listed rows, and one in 16 of the others; more once a list has a million values and the
    bits don't grow any further. What it holds is to be decided by a join with the list.
    """
    words = min(MARK_WORDS, listed.count() // 4 + 1)

    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(64 * words).cast("long"))

    bits = listed.select(place(entry).alias("place")).select(
        F.shiftright("place", 6).alias("_word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )
    marks = stage(bits.groupBy("_word").agg(F.bit_or("bit").alias("_bits")), "marks")
    placed = rows.withColumn("_place", place(own))
    placed = placed.join(F.broadcast(marks), F.shiftright("_place", 6) == F.col("_word"), "left")
    marked = F.coalesce(F.getbit("_bits", F.col("_place").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return tuple(placed.where(part).drop("_place", "_word", "_bits") for part in (marked, ~marked))


#: Rows of a batch whose texts are Python objects at a time.
SLICE = 256


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """A text column's values as UTF-8 bytes, null as empty; only some of them are copied at a time."""
    for at in range(0, len(texts), SLICE):
        for text in texts.slice(at, SLICE).cast(pa.binary()).to_pylist():
            yield text or b""


def utf8_lists(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    """Each batch with its text column's values, to be gone through once."""
    for batch in batches:
        yield batch, utf8(batch.column(batch.schema.get_field_index(column)))


def host_threads() -> None:
    """One thread per task: Spark already runs a task on each core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
