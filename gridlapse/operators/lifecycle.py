"""Collection and instance lifecycles, and the task tables joined from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.functions.buckets import in_window_range, window_index, window_start
from gridlapse.functions.expressions import effective_fields
from gridlapse.operators.rollup import (
    cpu_columns,
    power_rollup,
    select_machines,
    select_power,
    usage_on_machines,
)
from gridlapse.plans.skew import (
    HOT_SHARE,
    MIN_HOT_ROWS,
    counted_keys,
    key_counts,
    lookup_join,
    nested_lookup_join,
)
from gridlapse.schema import (
    COLLECTION_END_EVENTS,
    EVENT_ENABLE,
    EVENT_QUEUE,
    EVENT_SCHEDULE,
    EVENT_SUBMIT,
    INSTANCE_END_EVENTS,
    TASK_TRACE_COLUMNS,
    WINDOW_US,
)

COLLECTION = "collection_id"
TASK_KEYS = ["collection_id", "instance_index"]


def cell_keys(keys: Sequence[str], *frames: DataFrame) -> list[str]:
    """The keys, with the cell in front if all frames have it: ids count within a cell."""
    return [*(["cell"] if all("cell" in df.columns for df in frames) else []), *keys]


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def restrict_to_collections(events: DataFrame, usage: DataFrame) -> DataFrame:
    """Rows whose collection occurs in ``usage``. Works on events and on finished lifecycles."""
    keys = cell_keys([COLLECTION], events, usage)
    return events.join(distinct_keys(usage, keys), keys, "left_semi")


def _first_time(*event_types: int) -> Column:
    return F.min(F.when(F.col("type").isin(*event_types), F.col("time")))


def collection_lifecycle(events: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """One row per collection, of each cell if events have one.

    The restriction to collections of ``usage`` is stated after the aggregate, which commutes with
    it. Events are then combined map-side before any shuffle, however many a collection has;
    where the key list is small enough to broadcast, Spark moves the restriction below by itself.
    """
    lifecycle = events.groupBy(*cell_keys([COLLECTION], events)).agg(
        _first_time(EVENT_SUBMIT).alias("collection_submit_time"),
        _first_time(EVENT_SCHEDULE).alias("collection_schedule_time"),
        _first_time(*COLLECTION_END_EVENTS).alias("collection_end_time"),
        F.max(F.col("scheduling_class").cast("long")).alias("collection_scheduling_class"),
        F.max(F.col("collection_type").cast("long")).alias("collection_type_event"),
        F.max("priority").alias("collection_priority"),
        F.max(F.col("scheduler").cast("long")).alias("preferred_scheduler"),
        F.max(F.array_size("start_after_collection_ids")).cast("long").alias("dependency_count"),
        F.max(F.col("vertical_scaling").cast("long")).alias("vertical_scaling"),
    )
    return lifecycle if usage is None else restrict_to_collections(lifecycle, usage)


def instance_lifecycle(events: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """One row per (collection, instance), of each cell if events have one. Event 4 ends an instance, though not a collection."""
    lifecycle = events.groupBy(*cell_keys(TASK_KEYS, events)).agg(
        _first_time(EVENT_SUBMIT).alias("instance_submit_time"),
        _first_time(EVENT_QUEUE).alias("instance_queue_time"),
        _first_time(EVENT_ENABLE).alias("instance_enable_time"),
        _first_time(EVENT_SCHEDULE).alias("instance_start_time"),
        _first_time(*INSTANCE_END_EVENTS).alias("instance_end_time"),
        F.max(F.col("scheduling_class").cast("long")).alias("instance_scheduling_class"),
        F.max("priority").alias("instance_priority"),
    )
    return lifecycle if usage is None else restrict_to_collections(lifecycle, usage)


def placed_tasks(
    usage: DataFrame,
    machines: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
) -> DataFrame:
    """Usage rows in scope with their window and flattened CPU readings."""
    placed = usage_on_machines(
        usage.where(in_window_range("start_time", low, high, width_us)),
        select_machines(machines, cell, pdus),
    )
    index = window_index("start_time", width_us)
    return cpu_columns(placed).withColumns(
        {"window_index": index, "window_start": window_start(index, width_us)}
    )


def with_lifecycles(
    tasks: DataFrame,
    collection_events: DataFrame,
    instance_events: DataFrame,
    *,
    scoped: bool = False,
    hot_share: float | None = HOT_SHARE,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Task rows left-joined with both lifecycles.

    Task rows are by far the largest input. They are shuffled once, by collection: both lifecycles meet
    them there. ``scoped`` says that the tasks are a part of the usage: events of other collections are
    then left out before they are aggregated.
    """
    if scoped:
        keys = cell_keys([COLLECTION], tasks)
        found = counted_keys(key_counts(tasks, keys), keys)
        collection_events = restrict_to_collections(collection_events, found)
        instance_events = restrict_to_collections(instance_events, found)
    collections = collection_lifecycle(collection_events)
    instances = instance_lifecycle(instance_events)
    return nested_lookup_join(
        tasks,
        collections,
        cell_keys([COLLECTION], tasks, collections),
        instances,
        cell_keys(TASK_KEYS, tasks, instances),
        hot_share=hot_share,
        min_hot_rows=min_hot_rows,
    ).withColumn(
        "collection_type",
        F.coalesce(F.col("collection_type"), F.col("collection_type_event")).cast("long"),
    )


def task_trace(
    usage: DataFrame,
    machines: DataFrame,
    collection_events: DataFrame,
    instance_events: DataFrame,
    power: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
    hot_share: float | None = HOT_SHARE,
) -> DataFrame:
    """The 36-column task trace: usage, both lifecycles and the window's power."""
    scope = {"low": low, "high": high, "width_us": width_us}
    tasks = placed_tasks(usage, machines, cell=cell, pdus=pdus, **scope)
    scoped = any(x is not None for x in (cell, pdus, low, high))
    joined = with_lifecycles(tasks, collection_events, instance_events, scoped=scoped, hot_share=hot_share)
    windows = power_rollup(select_power(power, None if cell is None else [cell], pdus), **scope)
    keys = ["cell", "pdu", "window_index"]
    windows = windows.select(*keys, "measured_power_util", "production_power_util")
    return lookup_join(joined, windows, keys, counts=key_counts(tasks, keys), hot_share=hot_share).select(*TASK_TRACE_COLUMNS)


def task_states(
    usage: DataFrame,
    machines: DataFrame,
    collection_events: DataFrame,
    instance_events: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
    hot_share: float | None = HOT_SHARE,
) -> DataFrame:
    """Task rows with lifecycles and effective fields, ready for timing and classification."""
    tasks = placed_tasks(
        usage, machines, cell=cell, pdus=pdus, low=low, high=high, width_us=width_us
    )
    scoped = any(x is not None for x in (cell, pdus, low, high))
    return effective_fields(
        with_lifecycles(tasks, collection_events, instance_events, scoped=scoped, hot_share=hot_share)
    )
