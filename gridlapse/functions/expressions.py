"""Row-level predicates and derived values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlapse.functions.buckets import micros
from gridlapse.schema import (
    BATCH_SCHEDULER,
    JOB_COLLECTION_TYPE,
    UNKNOWN_SCHEDULING_CLASS,
    WINDOW_US,
    ZERO_FILL_COLUMNS,
)

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


# --- predicates ------------------------------------------------------------------------------


def not_in_alloc(column: str = "alloc_collection_id") -> Column:
    """NULL and 0 both mean "not inside an alloc set"."""
    return F.col(column).isNull() | (F.col(column) == 0)


def min_duration(duration_us: int = WINDOW_US) -> Column:
    return (F.col("end_time") - F.col("start_time")) >= F.lit(duration_us)


def good_power() -> Column:
    """Both quality flags must be false; an unknown flag drops the row as well."""
    return ~F.col("bad_measurement_data") & ~F.col("bad_production_power_data")


def usage_filter(exclude_alloc: bool = False, min_duration_us: int | None = None) -> Column:
    keep = F.lit(True)
    if exclude_alloc:
        keep = keep & not_in_alloc()
    if min_duration_us is not None:
        keep = keep & min_duration(min_duration_us)
    return keep


# --- null handling ---------------------------------------------------------------------------


def first_present(columns: Sequence[str], default: float | int | None = None) -> Column:
    values = [F.col(name) for name in columns]
    if default is not None:
        values.append(F.lit(default))
    return F.coalesce(*values)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """A zero or unknown denominator gives 0.0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def positive_share(part: Column, total: Column) -> Column:
    """part / total where the total is positive, else 0.0."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def greatest_or_null(value: Column, floor: int) -> Column:
    """``greatest`` that keeps NULL: the built-in one would skip it and return the floor."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def whole_number(text: Column) -> Column:
    """A bigint from text: ``123`` exactly, and ``123.0`` or ``1.5e12`` if they are whole."""
    real = text.try_cast("double")
    whole = (real == F.floor(real)) & (F.abs(real) < F.lit(float(1 << 63)))
    return F.coalesce(text.try_cast("bigint"), F.when(whole, real.try_cast("bigint")))


def coerce_numeric(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text to numbers; what does not parse becomes NULL, and NaN becomes NULL too."""
    casts = {}
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    for name, kind in types.items():
        if kind == "bigint" and name in texts:
            casts[name] = whole_number(F.trim(name))
            continue
        value = F.col(name).try_cast(kind)
        if kind in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        casts[name] = value
    return df.withColumns(casts)


def zero_defaults(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def fill_numeric(df: DataFrame, columns: Sequence[str] = ZERO_FILL_COLUMNS) -> DataFrame:
    """NULL and NaN become 0 in those of the fixed columns that are present."""
    return df.fillna(0.0, subset=[name for name in columns if name in df.columns])


# --- calendar and ratios ---------------------------------------------------------------------


def calendar_columns(timestamp: str = "window_start") -> dict[str, Column]:
    """UTC calendar features, whatever the session time zone is.

    They are read off the epoch microseconds: day 0 is a Thursday, and Monday counts as 0.
    """
    us = micros(timestamp)
    hour = F.pmod(F.floor(us / F.lit(float(HOUR_US))), F.lit(24)).cast("int")
    minute_of_day = F.pmod(F.floor(us / F.lit(float(MINUTE_US))), F.lit(1440)).cast("double")
    day = F.pmod(F.floor(us / F.lit(float(DAY_US))) + F.lit(3), F.lit(7)).cast("int")
    day_angle = F.lit(2.0 * math.pi) * minute_of_day / F.lit(1440.0)
    week_angle = F.lit(2.0 * math.pi) * day / F.lit(7.0)
    return {
        "hour": hour,
        "day_of_week": day,
        "is_weekend": day.isin(5, 6).cast("int"),
        "hour_sin": F.sin(day_angle),
        "hour_cos": F.cos(day_angle),
        "day_of_week_sin": F.sin(week_angle),
        "day_of_week_cos": F.cos(week_angle),
    }


def ratio_columns() -> dict[str, Column]:
    cpu = F.col("total_cpu_usage")
    return {
        "cpu_per_machine": guarded_ratio(cpu, F.col("machine_count")),
        "cpu_per_instance": guarded_ratio(cpu, F.col("instance_count")),
        "cpu_spread": F.col("max_cpu_usage") - F.col("avg_cpu_usage"),
    }


def calendar_features(df: DataFrame, timestamp: str = "window_start") -> DataFrame:
    return df.withColumns(calendar_columns(timestamp))


def ratio_features(df: DataFrame) -> DataFrame:
    return df.withColumns(ratio_columns())


def residual_target(
    df: DataFrame, label: str = "measured_power_util", anchor: str = "prev_measured_power_util"
) -> DataFrame:
    return df.withColumn(f"{label}_residual", F.col(label) - F.col(anchor))


# --- task rules ------------------------------------------------------------------------------


def effective_fields(df: DataFrame) -> DataFrame:
    """One scheduling class, priority, scheduler and collection type per task.

    The instance's own value wins over the collection's. An unknown class becomes one that can
    never be flexible; the other unknowns become 0.
    """
    return df.withColumns(
        {
            "effective_scheduling_class": first_present(
                ["instance_scheduling_class", "collection_scheduling_class"],
                UNKNOWN_SCHEDULING_CLASS,
            ),
            "effective_priority": first_present(["instance_priority", "collection_priority"], 0),
            "effective_scheduler": first_present(["preferred_scheduler"], 0),
            "effective_collection_type": first_present(["collection_type"], JOB_COLLECTION_TYPE),
            "dependency_count": first_present(["dependency_count"], 0),
        }
    )


def task_timing(
    df: DataFrame, rho: float = 1.5, min_runtime_us: int = WINDOW_US, default_time: int | None = None
) -> DataFrame:
    """Runtime, proxy deadline and remaining slack, in microseconds."""
    timed = df.withColumns(
        {
            "submit_time_us": first_present(
                ["instance_submit_time", "collection_submit_time", "start_time"], default_time
            ),
            "run_start_time_us": first_present(
                ["instance_start_time", "collection_schedule_time", "start_time"], default_time
            ),
            "run_end_time_us": first_present(
                ["instance_end_time", "collection_end_time", "end_time"], default_time
            ),
        }
    )
    timed = timed.withColumn(
        "actual_runtime_us",
        greatest_or_null(F.col("run_end_time_us") - F.col("run_start_time_us"), min_runtime_us),
    )
    timed = timed.withColumn(
        "proxy_deadline_us", F.col("submit_time_us") + F.lit(float(rho)) * F.col("actual_runtime_us")
    )
    return timed.withColumn(
        "remaining_slack_us",
        F.col("proxy_deadline_us") - (F.col("end_time") + F.col("actual_runtime_us")),
    )


def classify_tasks(
    df: DataFrame, max_class: int = 1, require_batch_scheduler: bool = True
) -> DataFrame:
    """Online, deferrable or critical.

    A candidate whose slack is unknown is neither deferrable nor critical (both flags are NULL),
    yet it stays a candidate.
    """
    flagged = df.withColumns(
        {
            "is_job": F.col("effective_collection_type") == JOB_COLLECTION_TYPE,
            "is_batch_scheduler": F.col("effective_scheduler") == BATCH_SCHEDULER,
            "in_alloc_set": ~not_in_alloc(),
        }
    )
    candidate = F.col("is_job") & (F.col("effective_scheduling_class") <= F.lit(max_class))
    if require_batch_scheduler:
        candidate = candidate & F.col("is_batch_scheduler")
    flagged = flagged.withColumn("is_flex_candidate", candidate)
    flagged = flagged.withColumn(
        "is_critical", F.col("is_flex_candidate") & (F.col("remaining_slack_us") <= 0)
    )
    return flagged.withColumns(
        {
            "is_deferrable": F.col("is_flex_candidate") & ~F.col("is_critical"),
            "is_online_like": ~F.col("is_flex_candidate"),
        }
    )
