"""Window rollups of task usage and power, and the training table built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.functions.buckets import in_window_range, window_index, window_start
from gridlapse.functions.expressions import good_power, not_in_alloc, usage_filter, zero_defaults
from gridlapse.plans.skew import HOT_SHARE, lookup_join, small_lookup
from gridlapse.schema import BASE_FEATURE_COLUMNS, TRAINING_COLUMNS, WINDOW_US

WINDOW_KEYS = ["cell", "pdu", "window_index"]
EXACT_KEYS = ["cell", "pdu", "window_start"]


def select_machines(
    machines: DataFrame, cell: str | None = None, pdus: Sequence[str] | None = None
) -> DataFrame:
    selected = machines
    if cell is not None:
        selected = selected.where(F.col("cell") == cell)
    if pdus is not None:
        selected = selected.where(F.col("pdu").isin(list(pdus)))
    return selected.select("machine_id", "pdu", "cell")


def machines_of_pdu(machines: DataFrame, pdu: str) -> DataFrame:
    return machines.where(F.col("pdu") == pdu).select("machine_id", "pdu").orderBy("machine_id")


def select_power(
    power: DataFrame, cells: Sequence[str] | None = None, pdus: Sequence[str] | None = None
) -> DataFrame:
    """IN lists on the partition columns of the power trace: they prune directories."""
    selected = power
    if cells is not None:
        selected = selected.where(F.col("cell").isin(list(cells)))
    if pdus is not None:
        selected = selected.where(F.col("pdu").isin(list(pdus)))
    return selected


def usage_on_machines(usage: DataFrame, machines: DataFrame) -> DataFrame:
    """Usage rows of the given machines, with their cell and PDU.

    A machine map of up to 500,000 rows is broadcast, so that usage stays where it is; beyond that
    Spark sorts, merges and splits skewed partitions. Usage without a cell fails while running on a
    machine id that the map has in several cells: its rows could be of either.
    """
    machines = small_lookup(machines.select("machine_id", "pdu", "cell"))
    if "cell" in usage.columns:
        return usage.join(machines, ["machine_id", "cell"])
    same_id = Window.partitionBy("machine_id")
    unclear = F.raise_error(F.concat(F.lit("Usage has no cell, and several have machine "), F.col("machine_id").cast("string")))
    one_cell = F.min("cell").over(same_id) == F.max("cell").over(same_id)
    single = F.when(one_cell | F.col("cell").isNull(), F.col("cell")).otherwise(unclear)
    return usage.join(machines.select("machine_id", "pdu", single.alias("cell")), ["machine_id"])


def cpu_columns(usage: DataFrame) -> DataFrame:
    """Flatten the two nested CPU readings; other struct members are never read."""
    return usage.withColumns(
        {
            "avg_cpu_usage": F.col("average_usage.cpus"),
            "max_cpu_usage": F.col("maximum_usage.cpus"),
        }
    ).drop("average_usage", "maximum_usage")


def _usage_measures(cpu: str) -> list:
    return [
        F.count(F.lit(1)).alias("instance_count"),
        F.countDistinct("collection_id").alias("collection_count"),
        F.countDistinct("machine_id").alias("machine_count"),
        F.sum(cpu).alias("total_cpu_usage"),
        F.avg(cpu).alias("avg_cpu_usage"),
        F.max(cpu).alias("max_cpu_usage"),
    ]


def usage_rollup(
    placed_usage: DataFrame,
    *,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
    exclude_alloc: bool = False,
    min_duration_us: int | None = None,
) -> DataFrame:
    """CPU usage per (cell, pdu, window).

    The two exact distinct counts make Spark expand each row to three and pre-aggregate each copy
    before the first shuffle. That shuffle is on (window, collection) and (window, machine), so a
    single hot window is spread over the cluster and only partial sums meet in the last step.
    """
    return (
        placed_usage.where(usage_filter(exclude_alloc, min_duration_us))
        .where(in_window_range("start_time", low, high, width_us))
        .select(
            "cell",
            "pdu",
            window_index("start_time", width_us).alias("window_index"),
            "collection_id",
            "machine_id",
            F.col("average_usage.cpus").alias("_cpu"),
        )
        .groupBy(*WINDOW_KEYS)
        .agg(*_usage_measures("_cpu"))
    )


def usage_rollup_exact(
    placed_usage: DataFrame,
    *,
    exclude_alloc: bool = True,
    min_duration_us: int | None = WINDOW_US,
) -> DataFrame:
    """The same measures per raw start time, without bucketing."""
    return (
        placed_usage.where(usage_filter(exclude_alloc, min_duration_us))
        .select(
            "cell",
            "pdu",
            F.col("start_time").alias("window_start"),
            "collection_id",
            "machine_id",
            F.col("average_usage.cpus").alias("_cpu"),
        )
        .groupBy(*EXACT_KEYS)
        .agg(*_usage_measures("_cpu"))
    )


def power_rollup(
    power: DataFrame,
    *,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
) -> DataFrame:
    """Mean power per (cell, pdu, window) over readings with clean quality flags."""
    return (
        power.where(good_power())
        .where(in_window_range("time", low, high, width_us))
        .groupBy("cell", "pdu", window_index("time", width_us).alias("window_index"))
        .agg(
            F.avg("measured_power_util").alias("measured_power_util"),
            F.avg("production_power_util").alias("production_power_util"),
        )
        .withColumn("window_start", window_start("window_index", width_us))
    )


def _with_usage(power: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    return zero_defaults(power.join(usage, keys, "left"), BASE_FEATURE_COLUMNS)


def power_with_usage(power_windows: DataFrame, usage_windows: DataFrame) -> DataFrame:
    """Every power window, with zeros where no usage fell into it.

    Both sides come out of an aggregate on the join keys: no further shuffle, and no hot key.
    """
    return _with_usage(power_windows, usage_windows, WINDOW_KEYS)


def power_with_usage_exact(power: DataFrame, usage_windows: DataFrame) -> DataFrame:
    """Raw power readings joined on equal start time. Readings are neither cleaned nor averaged."""
    readings = power.withColumnRenamed("time", "window_start")
    return _with_usage(readings, usage_windows, EXACT_KEYS)


def pdu_training_table(
    power: DataFrame,
    usage: DataFrame,
    machines: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
    exclude_alloc: bool = False,
    min_duration_us: int | None = None,
) -> DataFrame:
    """The 11-column training contract for a scope of PDUs and windows."""
    placed = usage_on_machines(usage, select_machines(machines, cell, pdus))
    usage_windows = usage_rollup(
        placed,
        low=low,
        high=high,
        width_us=width_us,
        exclude_alloc=exclude_alloc,
        min_duration_us=min_duration_us,
    )
    power_windows = power_rollup(
        select_power(power, None if cell is None else [cell], pdus),
        low=low,
        high=high,
        width_us=width_us,
    )
    return power_with_usage(power_windows, usage_windows).select(*TRAINING_COLUMNS)


def pdu_training_table_exact(
    power: DataFrame,
    usage: DataFrame,
    machines: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    exclude_alloc: bool = True,
    min_duration_us: int | None = WINDOW_US,
) -> DataFrame:
    placed = usage_on_machines(usage, select_machines(machines, cell, pdus))
    usage_windows = usage_rollup_exact(
        placed, exclude_alloc=exclude_alloc, min_duration_us=min_duration_us
    )
    readings = select_power(power, None if cell is None else [cell], pdus)
    return power_with_usage_exact(readings, usage_windows).select(*TRAINING_COLUMNS)


def instance_max_priority(instance_events: DataFrame) -> DataFrame:
    """Per task and machine, of each cell if events have one."""
    keys = ["collection_id", "instance_index", "machine_id"]
    keys = ["cell", *keys] if "cell" in instance_events.columns else keys
    return (
        instance_events.where(not_in_alloc()).groupBy(*keys).agg(F.max("priority").alias("priority"))
    )


def usage_with_priority(
    usage: DataFrame,
    instance_events: DataFrame,
    machines: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    exclude_alloc: bool = True,
    min_duration_us: int | None = WINDOW_US,
    hot_share: float | None = HOT_SHARE,
) -> DataFrame:
    placed = usage_on_machines(usage, select_machines(machines, cell, pdus)).where(
        usage_filter(exclude_alloc, min_duration_us)
    )
    priorities = instance_max_priority(instance_events)
    by_cell = ["cell"] if "cell" in priorities.columns else []
    facts = placed.select(
        *by_cell,
        F.col("start_time").alias("window_start"),
        F.col("end_time").alias("window_end"),
        "collection_id",
        "instance_index",
        "machine_id",
        F.col("average_usage.cpus").alias("cpu_usage"),
    )
    return lookup_join(
        facts,
        priorities,
        [*by_cell, "collection_id", "instance_index", "machine_id"],
        hot_share=hot_share,
    )


def sample_power_trace(power: DataFrame, rows: int = 288) -> DataFrame:
    """The first readings by time; ties are broken so that the choice is repeatable."""
    columns = ["time", "cell", "pdu", "measured_power_util", "production_power_util"]
    return power.select(*columns).orderBy(*[F.col(c).asc_nulls_last() for c in columns]).limit(rows)
