"""Versioned dataset writers.

Each writer makes a new version folder and publishes it when all is written (see :mod:`gridlapse.sources.versions`). It stores Parquet first and then counts what it stored, which reads file footers only
instead of running the plan a second time. Metadata is a one-row JSON dataset next to it, so it
lands on the same shared storage as the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.functions.buckets import with_utc_time
from gridlapse.operators.evaluate import leaderboard
from gridlapse.operators.flex import added_flex_columns, join_flex_features
from gridlapse.plans.stage import stage
from gridlapse.schema import FLEX_WINDOW_COLUMNS, require_columns
from gridlapse.sources.versions import new_version, publish

_FLEX_NOT_FEATURES = {"window_index", "cell", "pdu", "window_start"}


def _publish(spark: SparkSession, path: str, folder: str, metadata: dict) -> dict:
    """Add the metadata to a version and let readers have it."""
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    publish(spark, path, folder)
    return metadata


def _counts(spark: SparkSession, path: str) -> dict[str, int]:
    stored = spark.read.parquet(path)
    return {r["split"]: r["count"] for r in stored.groupBy("split").count().collect()}


def _gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Bring rows of the same directory together before a partitioned write.

    Otherwise every task writes a file into every directory. ``rebalance`` lets adaptive execution
    cut a large directory into several tasks and merge small ones, so a hot key is no bottleneck.
    """
    return df.hint("rebalance", *[F.col(key) for key in keys])


def _write_splits(df: DataFrame, path: str) -> None:
    gathered = _gathered(df, "split")
    gathered.sortWithinPartitions("split", "cell", "pdu", "window_start").write.partitionBy("split").parquet(path)


def write_dataset(
    df: DataFrame, path: str, version: str = "v1", label: str = "measured_power_util"
) -> dict:
    """Feature table with splits, or as one ``full`` part when it has no ``split`` column."""
    chronological = "split" in df.columns
    columns = [name for name in df.columns if name != "split"]
    folder = new_version(path)
    _write_splits(df if chronological else df.withColumn("split", F.lit("full")), f"{folder}/data")
    counts = _counts(df.sparkSession, f"{folder}/data")
    parts = ("train", "val", "test") if chronological else ("full",)
    metadata = {
        "version": version,
        "label": label,
        "split_mode": "chronological" if chronological else "full_only",
        "row_count": sum(counts.values()),
        **{f"{part}_rows": counts.get(part, 0) for part in parts},
        "columns": columns,
    }
    return _publish(df.sparkSession, path, folder, metadata)


def write_flex_trace(
    states: DataFrame,
    windows: DataFrame | Callable[[DataFrame], DataFrame],
    path: str,
    *,
    version: str = "flex_v1",
    rho: float = 1.5,
    max_class: int = 1,
    require_batch_scheduler: bool = True,
) -> dict:
    """Task trace and flex windows; ``windows`` may be a function that makes them from the stored trace.

    Given as a function, the classification of the tasks runs once.
    """
    spark, folder = states.sparkSession, new_version(path)
    written = _gathered(states, "cell", "pdu").write.partitionBy("cell", "pdu")
    written.parquet(f"{folder}/task_trace")
    if callable(windows):
        windows = windows(spark.read.schema(states.schema).parquet(f"{folder}/task_trace"))
    written = _gathered(windows, "cell", "pdu").write.partitionBy("cell", "pdu")
    written.parquet(f"{folder}/flex_windows")
    metadata = {
        "version": version,
        "rho": rho,
        "max_flex_scheduling_class": max_class,
        "require_batch_scheduler": require_batch_scheduler,
        "task_rows": spark.read.parquet(f"{folder}/task_trace").count(),
        "window_rows": spark.read.parquet(f"{folder}/flex_windows").count(),
        "columns": windows.columns,
    }
    return _publish(spark, path, folder, metadata)


def write_flex_dataset(windows: DataFrame, path: str, version: str = "flex_windows_v1") -> dict:
    """Packaged flex windows, sorted by (window_start, cell, pdu) inside each file."""
    windows = with_utc_time(require_columns(windows, FLEX_WINDOW_COLUMNS))
    folder = new_version(path)
    target = f"{folder}/flex_windows"
    windows.sortWithinPartitions("window_start", "cell", "pdu").write.parquet(target)
    stored = windows.sparkSession.read.parquet(target)
    facts = stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.struct("cell", "pdu")).alias("pdus"),
        F.min("window_index").alias("low"),
        F.max("window_index").alias("high"),
    ).first()
    metadata = {
        "version": version,
        "row_count": facts["rows"],
        "pdu_count": facts["pdus"],
        "window_index_min": facts["low"],
        "window_index_max": facts["high"],
        "columns": windows.columns,
    }
    return _publish(windows.sparkSession, path, folder, metadata)


def write_joined_dataset(
    dataset: DataFrame,
    flex: DataFrame,
    path: str,
    *,
    version: str,
    dataset_path: str = "",
    flex_path: str = "",
) -> dict:
    """Dataset with flex features, all splits in one job: the join key is unique across them."""
    spark = dataset.sparkSession
    has_split = "split" in dataset.columns
    base = dataset if has_split else dataset.withColumn("split", F.lit("full"))
    base_columns = [name for name in base.columns if name != "split"]
    joined = join_flex_features(base, flex)
    folder = new_version(path)
    _write_splits(joined, f"{folder}/data")
    counts = _counts(spark, f"{folder}/data")
    measures = [name for name in flex.columns if name not in _FLEX_NOT_FEATURES]
    metadata = {
        "version": version,
        "source_dataset_dir": dataset_path,
        "flex_path": flex_path,
        "split_mode": "full_only" if set(counts) == {"full"} else "chronological",
        "columns": [name for name in joined.columns if name != "split"],
        "flex_columns": added_flex_columns(base_columns, measures),
        "split_counts": counts,
    }
    return _publish(spark, path, folder, metadata)


def write_benchmark(
    benchmark: DataFrame, path: str, split: str = "test", keys: Sequence[str] = ("model",)
) -> dict:
    """Sorted benchmark as one CSV and one JSON file (one row per run), plus its best row.

    The benchmark is staged, so that the scoring below it runs once.
    """
    ordered = leaderboard(stage(benchmark, "benchmark"), split)
    single = ordered.coalesce(1)
    folder = new_version(path)
    single.write.csv(f"{folder}/benchmark_csv", header=True)
    single.write.json(f"{folder}/benchmark_json")
    best = ordered.first()
    wanted = [*keys, *[f"{split}_{m}" for m in ("mae", "rmse", "r2")]]
    summary = {} if best is None else {name: best[name] for name in wanted if name in best}
    return _publish(benchmark.sparkSession, path, folder, {"best": summary})
