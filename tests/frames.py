"""Small frames with the raw and contract schemas."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.schema import (
    COLLECTION_EVENTS_SCHEMA,
    INSTANCE_EVENTS_SCHEMA,
    INSTANCE_USAGE_SCHEMA,
    MACHINE_MAP_SCHEMA,
    POWER_TRACE_SCHEMA,
    TASK_TRACE_REQUIRED,
    contract_type,
)

W = 300_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def _frame(spark: SparkSession, schema, rows: list[dict], defaults: dict) -> DataFrame:
    filled = [{**defaults, **row} for row in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in filled], schema)


def power(spark, rows):
    defaults = {
        "cell": "f",
        "pdu": "pdu1",
        "measured_power_util": 0.5,
        "production_power_util": 0.4,
        "bad_measurement_data": False,
        "bad_production_power_data": False,
    }
    return _frame(spark, POWER_TRACE_SCHEMA, rows, defaults)


def machines(spark, rows=({"machine_id": 1},)):
    return _frame(spark, MACHINE_MAP_SCHEMA, list(rows), {"cell": "f", "pdu": "pdu1"})


def usage(spark, rows):
    filled = []
    for row in rows:
        row = dict(row)
        cpu = row.pop("cpu", 1.0)
        start = row.get("start_time", 0)
        filled.append(
            {
                "start_time": start,
                "end_time": start + W,
                "average_usage": (cpu, 0.0),
                "maximum_usage": (cpu * 2, 0.0),
                **row,
            }
        )
    defaults = {"collection_id": 1, "instance_index": 0, "machine_id": 1}
    return _frame(spark, INSTANCE_USAGE_SCHEMA, filled, defaults)


def collection_events(spark, rows):
    return _frame(spark, COLLECTION_EVENTS_SCHEMA, rows, {"collection_id": 1})


def instance_events(spark, rows):
    defaults = {"collection_id": 1, "instance_index": 0, "machine_id": 1}
    return _frame(spark, INSTANCE_EVENTS_SCHEMA, rows, defaults)


def task_trace(spark, rows):
    """Flexible candidates by default: job, class 0, batch scheduler."""
    defaults = {
        "window_start": at(0),
        "window_index": 0,
        "cell": "f",
        "pdu": "pdu1",
        "start_time": 0,
        "end_time": W,
        "collection_id": 1,
        "instance_index": 0,
        "machine_id": 1,
        "collection_type": 0,
        "collection_scheduling_class": 0,
        "preferred_scheduler": 1,
        "avg_cpu_usage": 1.0,
        "max_cpu_usage": 2.0,
        "measured_power_util": 0.5,
        "production_power_util": 0.4,
    }
    schema = ", ".join(f"{n} {contract_type(n).simpleString()}" for n in TASK_TRACE_REQUIRED)
    filled = [{**defaults, **row} for row in rows]
    return spark.createDataFrame(
        [tuple(r.get(n) for n in TASK_TRACE_REQUIRED) for r in filled], schema
    )


def series(spark, rows):
    """Training contract rows from (pdu, window index, label, cpu)."""
    data = [(pdu, index, float(label), float(cpu)) for pdu, index, label, cpu in rows]
    base = spark.createDataFrame(data, "pdu string, i long, label double, cpu double")
    return base.select(
        F.timestamp_micros(F.col("i") * W).alias("window_start"),
        F.lit("f").alias("cell"),
        "pdu",
        F.col("label").alias("measured_power_util"),
        (F.col("label") * 0.8).alias("production_power_util"),
        F.lit(4).cast("long").alias("instance_count"),
        F.lit(3).cast("long").alias("collection_count"),
        F.lit(2).cast("long").alias("machine_count"),
        F.col("cpu").alias("total_cpu_usage"),
        (F.col("cpu") / 4).alias("avg_cpu_usage"),
        (F.col("cpu") / 2).alias("max_cpu_usage"),
    )


def wavy(spark, pdus: int, length: int, step: int = 1):
    """Deterministic series with some shape, ``step`` windows apart."""
    ids = spark.range(pdus * length).select(
        F.concat(F.lit("pdu"), (F.col("id") % pdus).cast("string")).alias("pdu"),
        (F.floor(F.col("id") / pdus) * step).cast("long").alias("i"),
    )
    noise = (F.xxhash64("pdu", "i") % 1000) / 1000.0
    shaped = ids.withColumns(
        {
            "label": F.lit(0.6) + 0.1 * F.sin(F.col("i") / 40.0) + 0.01 * noise,
            "cpu": F.lit(400.0) + 30.0 * F.sin(F.col("i") / 40.0) + 5.0 * noise,
        }
    )
    return shaped.select(
        F.timestamp_micros(F.col("i") * W).alias("window_start"),
        F.lit("f").alias("cell"),
        "pdu",
        F.col("label").alias("measured_power_util"),
        (F.col("label") * 0.8).alias("production_power_util"),
        (F.lit(100) + F.pmod(F.col("i"), F.lit(7))).cast("long").alias("instance_count"),
        (F.lit(10) + F.pmod(F.col("i"), F.lit(3))).cast("long").alias("collection_count"),
        F.lit(20).cast("long").alias("machine_count"),
        F.col("cpu").alias("total_cpu_usage"),
        (F.col("cpu") / 100).alias("avg_cpu_usage"),
        (F.col("cpu") / 50 + noise).alias("max_cpu_usage"),
    )
