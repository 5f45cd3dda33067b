"""The window rollups over a stream: rows arrive in any order, windows are given out once they can't change.

A window is complete when the watermark, the latest time seen less the allowed delay, has passed its end; rows that come later are left out.
State is what open windows hold. A distinct count's state is one entry for each value of an open window, dropped with it: values
are deduplicated by window before they are counted. Results are appended, so they can be files. All functions
take and give streaming frames; on a plain frame they give the batch result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlapse.functions.expressions import good_power, usage_filter
from gridlapse.operators.mergeable import MEMBERS
from gridlapse.schema import WINDOW_US

_AT, _WINDOW = "_at", "_window"


def _in_windows(rows: DataFrame, time: str, width_us: int, delay: str) -> DataFrame:
    timed = rows.withColumn(_AT, F.timestamp_micros(time)).withWatermark(_AT, delay)
    return timed.withColumn(_WINDOW, F.window(_AT, f"{width_us} microseconds"))


def _index(width_us: int) -> Column:
    start = F.unix_micros(F.col(f"{_WINDOW}.start"))
    return F.floor(start / F.lit(float(width_us))).cast("long").alias("window_index")


def power_windows(readings: DataFrame, *, width_us: int = WINDOW_US, delay: str = "10 minutes") -> DataFrame:
    """Mean power per (cell, pdu, window), as of :func:`gridlapse.operators.rollup.power_rollup`."""
    rows = _in_windows(readings.where(good_power()), "time", width_us, delay)
    measured = rows.groupBy("cell", "pdu", _WINDOW).agg(
        F.avg("measured_power_util").alias("measured_power_util"),
        F.avg("production_power_util").alias("production_power_util"),
    )
    return measured.select("cell", "pdu", _index(width_us), "measured_power_util", "production_power_util")


def _scoped(placed_usage: DataFrame, exclude_alloc: bool, min_duration_us: int | None) -> DataFrame:
    used = placed_usage.where(usage_filter(exclude_alloc, min_duration_us))
    return used.select("cell", "pdu", "start_time", *MEMBERS, F.col("average_usage.cpus").alias("_cpu"))


def usage_sums(
    placed_usage: DataFrame, *, width_us: int = WINDOW_US, delay: str = "10 minutes", exclude_alloc: bool = False, min_duration_us: int | None = None
) -> DataFrame:
    """The measures of a usage window that add up."""
    rows = _in_windows(_scoped(placed_usage, exclude_alloc, min_duration_us), "start_time", width_us, delay)
    summed = rows.groupBy("cell", "pdu", _WINDOW).agg(
        F.count(F.lit(1)).alias("instance_count"),
        F.sum("_cpu").alias("total_cpu_usage"),
        F.avg("_cpu").alias("avg_cpu_usage"),
        F.max("_cpu").alias("max_cpu_usage"),
    )
    return summed.select("cell", "pdu", _index(width_us), "instance_count", "total_cpu_usage", "avg_cpu_usage", "max_cpu_usage")


def usage_members(
    placed_usage: DataFrame, *, width_us: int = WINDOW_US, delay: str = "10 minutes", exclude_alloc: bool = False, min_duration_us: int | None = None
) -> DataFrame:
    """(cell, pdu, window_index, measure, members): the different collections and machines of a usage window."""
    rows = _in_windows(_scoped(placed_usage, exclude_alloc, min_duration_us), "start_time", width_us, delay)
    entries = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(column).alias("id")) for column, name in MEMBERS.items()])
    listed = rows.select("cell", "pdu", _AT, _WINDOW, F.explode(entries).alias("_entry")).select(
        "cell", "pdu", _AT, _WINDOW, "_entry.measure", "_entry.id"
    )
    once = listed.where("id IS NOT NULL").dropDuplicates(["cell", "pdu", _WINDOW, "measure", "id"])
    counted = once.groupBy("cell", "pdu", "measure", _WINDOW).agg(F.count(F.lit(1)).alias("members"))
    return counted.select("cell", "pdu", _index(width_us), "measure", "members")


def with_members(sums: DataFrame, members: DataFrame) -> DataFrame:
    """Stored sums and member counts as one rollup."""
    keys = ["cell", "pdu", "window_index"]
    wide = members.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("members"))).alias(m) for m in MEMBERS.values()])
    joined = sums.join(wide, keys, "left")
    return joined.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in MEMBERS.values()})


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work on what there is by now, in one or several batches, and append complete windows to ``path``.

    The state of open windows stays in ``checkpoint``; the next call goes on from there.
    """
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
