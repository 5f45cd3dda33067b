"""Task tables stored by task, so that joins and aggregates by task need no shuffle of the rows.

Usage and instance events are written as tables of the session's catalog, bucketed by the task's key. A bucket is one
file, rows of a task are in the same bucket of both, and Spark reads bucket for bucket. It pays from the second query on; the
first shuffle is the write. Choose at least as many buckets as shuffle partitions: with fewer Spark prefers to shuffle.
Files are not sorted: joins sort what they read whether it is or not, and a sorted write compares rows by the bucket first,
which it computes anew for each comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.functions.expressions import effective_fields
from gridlapse.operators.lifecycle import (
    COLLECTION,
    TASK_KEYS,
    cell_keys,
    collection_lifecycle,
    instance_lifecycle,
    placed_tasks,
    with_lifecycles,
)
from gridlapse.plans.skew import key_counts, lookup_join


@dataclass(frozen=True)
class TaskTables:
    """Names of the stored tables."""

    name: str

    @property
    def usage(self) -> str:
        return f"{self.name}_usage"

    @property
    def events(self) -> str:
        return f"{self.name}_instance_events"


def write_task_tables(usage: DataFrame, instance_events: DataFrame, name: str, path: str, buckets: int) -> TaskTables:
    """Store both by the task's key, and by cell if both have one. Tables of that name are replaced."""
    tables = TaskTables(name)
    keys = cell_keys(TASK_KEYS, usage, instance_events)
    for table, df in ((tables.usage, usage), (tables.events, instance_events)):
        gathered = df.repartition(buckets, *keys)  # one file for each bucket
        written = gathered.write.bucketBy(buckets, *keys).mode("overwrite").format("parquet")
        written.option("path", f"{path}/{table}").saveAsTable(table)
    return tables


def tasks_with_lifecycles(spark: SparkSession, tables: TaskTables, machines: DataFrame, collection_events: DataFrame, **scope) -> DataFrame:
    """Task rows with both lifecycles, as of :func:`gridlapse.operators.lifecycle.with_lifecycles`.

    The stored rows stay in their buckets. Only the collections' attributes are shuffled, to the distinct task keys and with
    them back to the buckets: one row for each task. Rows without a complete key can't be joined by it and take the other
    way. A task has one row per window, so a bucket's size is bound by the tasks in it; adaptive execution doesn't split buckets.
    """
    usage, events = spark.table(tables.usage), spark.table(tables.events)
    keys = cell_keys(TASK_KEYS, usage, events)
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    tasks = placed_tasks(usage, machines, **scope)
    whole = tasks.where(complete)
    found = whole.select(*keys).distinct()
    instances = instance_lifecycle(events.where(complete))
    instances = instances.withColumnsRenamed({k: f"_own_{k}" for k in keys})
    own = found.join(instances, [F.col(k) == F.col(f"_own_{k}") for k in keys], "left").drop(*[f"_own_{k}" for k in keys])
    of_collection = cell_keys([COLLECTION], own, collection_events)
    # Without NULL keys, as with_lifecycles has them: the rows of the other way then reuse this aggregate.
    collections = collection_lifecycle(collection_events).dropna(subset=of_collection)
    attributes = lookup_join(own, collections, of_collection, counts=key_counts(found, of_collection))
    renamed = attributes.withColumnsRenamed({k: f"_task_{k}" for k in keys})
    joined = whole.join(renamed, [F.col(k) == F.col(f"_task_{k}") for k in keys], "left").drop(*[f"_task_{k}" for k in keys])
    joined = joined.withColumn("collection_type", F.coalesce(F.col("collection_type"), F.col("collection_type_event")).cast("long"))
    rest = with_lifecycles(tasks.where(~complete), collection_events, events.where(~complete))
    return joined.unionByName(rest.select(*joined.columns))


def task_states(spark: SparkSession, tables: TaskTables, machines: DataFrame, collection_events: DataFrame, **scope) -> DataFrame:
    """Task rows with lifecycles and effective fields, from stored tables."""
    return effective_fields(tasks_with_lifecycles(spark, tables, machines, collection_events, **scope))
