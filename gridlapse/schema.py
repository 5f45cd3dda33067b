"""Column contracts, table schemas, event codes and named feature sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: they must equal the published data contract -------------------------------

WINDOW_US = 300_000_000

JOB_COLLECTION_TYPE = 0
BATCH_SCHEDULER = 1
UNKNOWN_SCHEDULING_CLASS = 99

EVENT_SUBMIT = 0
EVENT_QUEUE = 1
EVENT_ENABLE = 2
EVENT_SCHEDULE = 3
COLLECTION_END_EVENTS = (5, 6, 7, 8)
INSTANCE_END_EVENTS = (4, 5, 6, 7, 8)

SERIES_KEYS = ("cell", "pdu")
ID_COLUMNS = ("cell", "pdu", "window_start")
FLEX_JOIN_KEYS = ("window_start", "cell", "pdu")
FLEX_PREFIX = "flex_window_"
CSV_HEADER_PREFIX = "window_start,window_index,cell,pdu"

LABEL_COLUMNS = ("measured_power_util", "production_power_util")

BASE_FEATURE_COLUMNS = (
    "instance_count",
    "collection_count",
    "machine_count",
    "total_cpu_usage",
    "avg_cpu_usage",
    "max_cpu_usage",
)

TRAINING_COLUMNS = ("window_start", "cell", "pdu") + LABEL_COLUMNS + BASE_FEATURE_COLUMNS

CALENDAR_COLUMNS = (
    "hour",
    "day_of_week",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
)

LAG_COLUMNS = (
    "prev_measured_power_util",
    "prev_production_power_util",
    "prev_total_cpu_usage",
    "delta_total_cpu_usage",
)

RATIO_COLUMNS = ("cpu_per_machine", "cpu_per_instance", "cpu_spread")

FEATURE_TABLE_COLUMNS = TRAINING_COLUMNS + CALENDAR_COLUMNS + LAG_COLUMNS + RATIO_COLUMNS

ZERO_FILL_COLUMNS = (
    BASE_FEATURE_COLUMNS
    + LAG_COLUMNS
    + RATIO_COLUMNS
    + ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos")
)

FLEX_WINDOW_COLUMNS = (
    "window_start",
    "window_index",
    "cell",
    "pdu",
    "task_count",
    "job_count",
    "machine_count",
    "total_cpu_usage",
    "online_cpu_usage",
    "flex_cpu_usage",
    "critical_cpu_usage",
    "batch_candidate_cpu_usage",
    "online_task_count",
    "deferrable_task_count",
    "critical_task_count",
    "mean_deferrable_slack_us",
    "max_dependency_count",
    "mean_priority",
    "mean_scheduling_class",
    "flex_cpu_ratio",
    "critical_cpu_ratio",
    "online_cpu_ratio",
    "measured_power_util",
    "production_power_util",
)

TASK_TRACE_COLUMNS = (
    "window_start",
    "window_index",
    "cell",
    "pdu",
    "start_time",
    "end_time",
    "collection_id",
    "instance_index",
    "machine_id",
    "alloc_collection_id",
    "alloc_instance_index",
    "collection_type",
    "collection_submit_time",
    "collection_schedule_time",
    "collection_end_time",
    "collection_scheduling_class",
    "collection_priority",
    "preferred_scheduler",
    "dependency_count",
    "vertical_scaling",
    "instance_submit_time",
    "instance_queue_time",
    "instance_enable_time",
    "instance_start_time",
    "instance_end_time",
    "instance_scheduling_class",
    "instance_priority",
    "avg_cpu_usage",
    "max_cpu_usage",
    "assigned_memory",
    "page_cache_memory",
    "cycles_per_instruction",
    "memory_accesses_per_instruction",
    "sample_rate",
    "measured_power_util",
    "production_power_util",
)

# The task-trace builder does not need the last seven export-only columns.
TASK_TRACE_REQUIRED = tuple(
    name
    for name in TASK_TRACE_COLUMNS
    if name
    not in {
        "alloc_instance_index",
        "vertical_scaling",
        "assigned_memory",
        "page_cache_memory",
        "cycles_per_instruction",
        "memory_accesses_per_instruction",
        "sample_rate",
    }
)

TASK_STATE_COLUMNS = (
    "submit_time_us",
    "run_start_time_us",
    "run_end_time_us",
    "actual_runtime_us",
    "proxy_deadline_us",
    "remaining_slack_us",
    "effective_scheduling_class",
    "effective_priority",
    "effective_scheduler",
    "is_job",
    "is_batch_scheduler",
    "in_alloc_set",
    "is_flex_candidate",
    "is_critical",
    "is_deferrable",
    "is_online_like",
)

_CYCLIC = BASE_FEATURE_COLUMNS + (
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
    "prev_measured_power_util",
    "prev_total_cpu_usage",
)
_LEGACY = BASE_FEATURE_COLUMNS + (
    "hour",
    "day_of_week",
    "is_weekend",
    "prev_measured_power_util",
    "prev_total_cpu_usage",
)
_COMPACT = _CYCLIC + ("prev_production_power_util", "delta_total_cpu_usage", "cpu_spread")

FEATURE_SETS = {
    "legacy": _LEGACY,
    "cyclic": _CYCLIC,
    "compact": _COMPACT,
    "enhanced": _COMPACT + ("cpu_per_machine", "cpu_per_instance"),
    "flex": _LEGACY
    + (
        "task_count",
        "job_count",
        "online_cpu_usage",
        "flex_cpu_usage",
        "critical_cpu_usage",
        "batch_candidate_cpu_usage",
        "online_task_count",
        "deferrable_task_count",
        "critical_task_count",
        "mean_deferrable_slack_us",
        "max_dependency_count",
        "mean_priority",
        "mean_scheduling_class",
        "flex_cpu_ratio",
        "critical_cpu_ratio",
        "online_cpu_ratio",
    ),
}

BASELINE_FEATURES = {
    "persistence": ("prev_measured_power_util",),
    "moving_average": ("prev_measured_power_util", "prev_total_cpu_usage"),
    "linear_regression": _LEGACY,
    "ridge": _LEGACY,
    "cpu_heuristic": ("total_cpu_usage",),
    "random_forest": _LEGACY,
}

DEFAULT_SEEDS = (42, 7, 21)
METRICS = ("mae", "rmse", "mape", "smape", "r2")

# --- raw table schemas -----------------------------------------------------------------------

_LONG, _DOUBLE, _STRING, _BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RESOURCES = _struct(cpus=_DOUBLE, memory=_DOUBLE)

POWER_TRACE_SCHEMA = _struct(
    time=_LONG,
    measured_power_util=_DOUBLE,
    production_power_util=_DOUBLE,
    bad_measurement_data=_BOOL,
    bad_production_power_data=_BOOL,
    cell=_STRING,
    pdu=_STRING,
)

MACHINE_MAP_SCHEMA = _struct(machine_id=_LONG, pdu=_STRING, cell=_STRING)

INSTANCE_USAGE_SCHEMA = _struct(
    start_time=_LONG,
    end_time=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    alloc_collection_id=_LONG,
    alloc_instance_index=_LONG,
    collection_type=_LONG,
    average_usage=RESOURCES,
    maximum_usage=RESOURCES,
    assigned_memory=_DOUBLE,
    page_cache_memory=_DOUBLE,
    cycles_per_instruction=_DOUBLE,
    memory_accesses_per_instruction=_DOUBLE,
    sample_rate=_DOUBLE,
)

COLLECTION_EVENTS_SCHEMA = _struct(
    time=_LONG,
    collection_id=_LONG,
    type=_LONG,
    scheduling_class=_LONG,
    collection_type=_LONG,
    priority=_LONG,
    scheduler=_LONG,
    vertical_scaling=_LONG,
    start_after_collection_ids=T.ArrayType(_LONG),
)

INSTANCE_EVENTS_SCHEMA = _struct(
    time=_LONG,
    collection_id=_LONG,
    instance_index=_LONG,
    machine_id=_LONG,
    alloc_collection_id=_LONG,
    type=_LONG,
    scheduling_class=_LONG,
    priority=_LONG,
)

_STRING_NAMES = {"cell", "pdu"}
_DOUBLE_NAMES = {
    "avg_cpu_usage",
    "max_cpu_usage",
    "assigned_memory",
    "page_cache_memory",
    "cycles_per_instruction",
    "memory_accesses_per_instruction",
    "sample_rate",
    "total_cpu_usage",
    "online_cpu_usage",
    "flex_cpu_usage",
    "critical_cpu_usage",
    "batch_candidate_cpu_usage",
    "mean_deferrable_slack_us",
    "mean_priority",
    "mean_scheduling_class",
    "flex_cpu_ratio",
    "critical_cpu_ratio",
    "online_cpu_ratio",
    "proxy_deadline_us",
    "remaining_slack_us",
} | set(LABEL_COLUMNS) | set(LAG_COLUMNS) | set(RATIO_COLUMNS)


def contract_type(name: str) -> T.DataType:
    """Spark type of a contract column, used when text is parsed."""
    if name in _STRING_NAMES:
        return _STRING
    if name == "window_start":
        return T.TimestampType()
    if name in _DOUBLE_NAMES or name.endswith(("_sin", "_cos")):
        return _DOUBLE
    return _LONG


def require_columns(df: DataFrame, required: Iterable[str], what: str = "columns") -> DataFrame:
    """Check names only (no job) and hand the frame back, so the call can be chained."""
    present = set(df.columns)
    missing = [name for name in required if name not in present]
    if missing:
        raise ValueError(f"The frame lacks {what}: {missing}")
    return df


def feature_set(name: str = "enhanced") -> list[str]:
    if name not in FEATURE_SETS:
        raise ValueError(f"No feature set named {name!r}; there are {sorted(FEATURE_SETS)}")
    return list(FEATURE_SETS[name])
