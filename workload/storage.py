"""Round trips: what a reader or writer of the library makes of the test tables.

Files go below the session's stage folder, each run into a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.operators import baselines, evaluate, features, flex, mergeable
from gridlapse.plans.stage import stage_directory
from gridlapse.schema import CSV_HEADER_PREFIX, feature_set
from gridlapse.functions import expressions
from gridlapse.streaming import rollup as streaming
from gridlapse.sources import layout, readers, versions, writers
from workload.adapters import DAY, MONTH, Trace
from workload.catalog import LABEL, SIMPLE_MODELS, TIMED_STATES, built, dataset, placed, query, runs

FLEX_CSV = ("window_start", "window_index", "cell", "pdu", "task_count", "flex_cpu_ratio")


def folder(t: Trace, name: str) -> str:
    return f"{stage_directory(t.spark)}/{name}-{uuid.uuid4().hex}"


def states(t: Trace) -> DataFrame:
    return flex.build_task_states(t.trace)


@query
def read_frame(t: Trace) -> DataFrame:
    path = folder(t, "series") + ".csv"
    plain = t.series.withColumn("window_start", F.unix_micros("window_start"))
    plain.write.csv(path, header=True)
    return readers.read_frame(t.spark, path, plain.schema)


@query
def read_csv_with_preamble(t: Trace) -> DataFrame:
    """Export as a console tool prints it: some other lines, the header, then the rows."""
    path = folder(t, "export") + ".csv"
    windows = flex.flex_windows(states(t))
    stamp = F.concat(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    cells = [stamp if name == "window_start" else F.col(name).cast("string") for name in FLEX_CSV]
    # Whole numbers as tools write them for columns with gaps.
    cells = [F.concat(c, F.lit(".0")) if n in ("window_index", "task_count") else c for c, n in zip(cells, FLEX_CSV)]
    rows = windows.select(F.concat_ws(",", *cells).alias("value"))
    assert ",".join(FLEX_CSV).startswith(CSV_HEADER_PREFIX)
    head = ["SELECT t.window_start, count(*)", "FROM tasks AS t", "", ",".join(FLEX_CSV)]
    preamble = t.spark.createDataFrame([(line,) for line in head], "value string")
    preamble.unionByName(rows).write.text(path)
    return readers.read_csv_with_preamble(t.spark, path)


@query
def read_power_trace(t: Trace) -> DataFrame:
    path = folder(t, "power")
    t.power.write.partitionBy("cell", "pdu").parquet(path)
    return readers.read_power_trace(
        t.spark, path, ["ASIA", "AMERICA"], ["NATION_2", "NATION_6", "NATION_12", "NATION_16"]
    )


@query
def read_usage(t: Trace) -> DataFrame:
    path = folder(t, "usage")
    placed(t).drop("pdu").write.partitionBy("cell").parquet(path)
    usage = readers.read_usage(t.spark, path, ["ASIA", "EUROPE"])
    return usage.select(
        "cell", "machine_id", "start_time", F.col("average_usage.cpus").alias("avg_cpus")
    )


@query
def read_collection_events(t: Trace) -> DataFrame:
    path = folder(t, "collection-events")
    t.collection_events.write.parquet(path)
    return readers.read_collection_events(t.spark, path).select(
        "collection_id", "time", "type", "priority", F.size("start_after_collection_ids").alias("deps")
    )


@query
def read_instance_events(t: Trace) -> DataFrame:
    path = folder(t, "instance-events")
    t.instance_events.write.parquet(path)
    return readers.read_instance_events(t.spark, path)


@query
def read_machine_map(t: Trace) -> DataFrame:
    path = folder(t, "machines")
    t.machines.write.parquet(path)
    return readers.read_machine_map(t.spark, path)


@query
def named_feature_set(t: Trace) -> DataFrame:
    return built(t).select("cell", "pdu", "window_start", *feature_set("enhanced"))


@query
def write_dataset(t: Trace) -> DataFrame:
    path = folder(t, "dataset")
    writers.write_dataset(dataset(t), path, "v1", LABEL)
    return readers.read_dataset(t.spark, path).select(
        "cell", "pdu", "window_start", LABEL, "prev_measured_power_util", "split"
    )


@query
def write_dataset_metadata(t: Trace) -> DataFrame:
    path = folder(t, "dataset")
    writers.write_dataset(dataset(t), path, "v1", LABEL)
    return readers.read_metadata(t.spark, path).select(
        "version",
        "label",
        "split_mode",
        "row_count",
        "train_rows",
        "val_rows",
        "test_rows",
        F.size("columns").alias("column_count"),
    )


@query
def write_flex_trace(t: Trace) -> DataFrame:
    path = folder(t, "flex-trace")
    tasks = states(t)
    writers.write_flex_trace(tasks, flex.flex_windows, path, version="flex_v1")
    return readers.read_metadata(t.spark, path).select(
        "version", "rho", "max_flex_scheduling_class", "task_rows", "window_rows"
    )


@query
def write_flex_dataset(t: Trace) -> DataFrame:
    path = folder(t, "flex")
    writers.write_flex_dataset(flex.flex_windows(states(t)), path)
    return readers.read_metadata(t.spark, path).select(
        "row_count", "pdu_count", "window_index_min", "window_index_max"
    )


@query
def write_joined_dataset(t: Trace) -> DataFrame:
    path = folder(t, "joined")
    data = features.chronological_split(t.series)
    writers.write_joined_dataset(data, flex.flex_windows(states(t)), path, version="v1_flex")
    return readers.read_dataset(t.spark, path).select(
        "cell", "pdu", "window_start", "split", "task_count", "flex_window_machine_count"
    )


@query
def write_benchmark(t: Trace) -> DataFrame:
    path = folder(t, "benchmark")
    data = dataset(t)
    train = data.where(F.col("split") == "train")
    fitted = [baselines.fit_baseline(name, train, LABEL) for name in SIMPLE_MODELS]
    metrics = evaluate.regression_metrics(baselines.predict_all(fitted, data, LABEL))
    writers.write_benchmark(evaluate.benchmark_table(metrics), path)
    stored = t.spark.read.csv(f"{versions.current(t.spark, path)}/benchmark_csv", header=True, inferSchema=True)
    return stored.select("model", "val_mae", "val_rmse", "test_mae", "test_rmse", "test_r2")


@query
def read_benchmark(t: Trace) -> DataFrame:
    path = folder(t, "runs")
    table = evaluate.benchmark_table(runs(t))
    writers.write_benchmark(table, path)
    return readers.read_benchmark(t.spark, path, table.schema)


@query
def usage_rollup_from_parts(t: Trace) -> DataFrame:
    """Weeks from stored parts of days, without the usage."""
    path = folder(t, "usage-parts")
    mergeable.usage_parts(placed(t), width_us=DAY).write(path)
    stored = mergeable.UsageParts.read(t.spark, path, DAY)
    return mergeable.rollup_of_parts(mergeable.merge_parts(stored, 7 * DAY))


@query
def task_states_from_tables(t: Trace) -> DataFrame:
    """Task states from tables that are bucketed by task."""
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    path = folder(t, "task-tables")
    tables = layout.write_task_tables(t.usage, t.instance_events, f"tasks_{uuid.uuid4().hex}", path, buckets)
    states = layout.task_states(t.spark, tables, t.machines, t.collection_events, width_us=MONTH)
    return expressions.task_timing(states, 1.5).select(*TIMED_STATES)


@query
def power_rollup_stream(t: Trace) -> DataFrame:
    """Days of power readings from a stream of files, as far as they can't change any more."""
    path, out = folder(t, "readings"), folder(t, "stream")
    t.power.write.parquet(path)
    stream = t.spark.readStream.schema(t.power.schema).parquet(path)
    days = streaming.power_windows(stream, width_us=DAY, delay="2 days")
    streaming.append_to(days, out, f"{out}-state").awaitTermination()
    return t.spark.read.schema(days.schema).parquet(out)


@query
def ranked_times(t: Trace) -> DataFrame:
    return features.ranked_times(t.series, block_us=3 * DAY)
