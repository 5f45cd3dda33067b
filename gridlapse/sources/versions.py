"""Versions of a stored dataset: a write makes a new folder, and one line of text names the one that counts.

The line is replaced in one step after everything of the version is written. Until then readers get the old
version, and a write that fails or is killed leaves it as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: The file that names the version.
CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def new_version(path: str) -> str:
    """A folder below ``path`` that no reader looks at yet."""
    return f"{path}/version-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Make ``folder``, one of :func:`new_version`, the version that readers of ``path`` get."""
    name = folder.rsplit("/", 1)[-1]
    files, draft = _files(spark, f"{path}/{CURRENT}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(f"{name}\n", "utf-8"))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(draft), files.makeQualified(target), overwrite)


def current(spark: SparkSession, path: str) -> str:
    """Folder of the version that counts; ``path`` itself if it was written without versions."""
    files, manifest = _files(spark, f"{path}/{CURRENT}")
    if not files.exists(manifest):
        return path
    return f"{path}/{spark.read.text(str(manifest.toString())).first()[0].strip()}"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of all versions, also of writes that never ended."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    return sorted(f"{path}/{s.getPath().getName()}" for s in files.listStatus(folder) if s.getPath().getName().startswith("version-"))


def remove_superseded(spark: SparkSession, path: str) -> list[str]:
    """Delete all versions but the one that counts. No write and no reader of an old version may be under way."""
    kept = current(spark, path)
    gone = [folder for folder in versions(spark, path) if folder != kept] if kept != path else []
    for folder in gone:
        files, where = _files(spark, folder)
        files.delete(where, True)
    return gone
