"""Flexibility windows: how much of each window's CPU is online, deferrable or critical."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.functions.buckets import with_utc_time
from gridlapse.functions.expressions import (
    classify_tasks,
    coerce_numeric,
    effective_fields,
    positive_share,
    task_timing,
)
from gridlapse.operators.lifecycle import task_states
from gridlapse.operators.rollup import power_rollup, select_power
from gridlapse.plans.skew import HOT_SHARE
from gridlapse.schema import (
    FLEX_JOIN_KEYS,
    FLEX_PREFIX,
    FLEX_WINDOW_COLUMNS,
    LABEL_COLUMNS,
    TASK_TRACE_REQUIRED,
    WINDOW_US,
    contract_type,
    require_columns,
)

FLEX_KEYS = ["window_start", "window_index", "cell", "pdu"]


def build_task_states(
    trace: DataFrame,
    *,
    rho: float = 1.5,
    max_class: int = 1,
    require_batch_scheduler: bool = True,
    min_runtime_us: int = WINDOW_US,
    default_time: int | None = 0,
) -> DataFrame:
    """Classified tasks from an exported task trace, whose numbers may still be text."""
    require_columns(trace, TASK_TRACE_REQUIRED)
    # Times, names and ids stay as they are: an id may be any text.
    untyped = {"window_start", "cell", "pdu", "window_index", "collection_id", "instance_index", "machine_id"}
    numeric = {
        name: contract_type(name).simpleString()
        for name in TASK_TRACE_REQUIRED
        if name not in untyped and name in trace.columns
    }
    typed = coerce_numeric(with_utc_time(trace), numeric)
    timed = task_timing(effective_fields(typed), rho, min_runtime_us, default_time)
    return classify_tasks(timed, max_class, require_batch_scheduler)


def _conditional(flag: str, value: str) -> Column:
    return F.sum(F.when(F.col(flag), F.col(value)).otherwise(F.lit(0.0)))


def aggregate_flex(states: DataFrame, null_slack_as_zero: bool = False) -> DataFrame:
    """Measures per window from classified tasks, without power."""
    deferrable_slack = F.avg(F.when(F.col("is_deferrable"), F.col("remaining_slack_us")))
    if null_slack_as_zero:
        deferrable_slack = F.coalesce(deferrable_slack, F.lit(0.0))
    power = [F.avg(name).alias(name) for name in LABEL_COLUMNS if name in states.columns]
    windows = states.groupBy(*FLEX_KEYS).agg(
        F.count(F.lit(1)).alias("task_count"),
        F.countDistinct("collection_id").alias("job_count"),
        F.countDistinct("machine_id").alias("machine_count"),
        F.sum("avg_cpu_usage").alias("total_cpu_usage"),
        _conditional("is_online_like", "avg_cpu_usage").alias("online_cpu_usage"),
        _conditional("is_deferrable", "avg_cpu_usage").alias("flex_cpu_usage"),
        _conditional("is_critical", "avg_cpu_usage").alias("critical_cpu_usage"),
        _conditional("is_flex_candidate", "avg_cpu_usage").alias("batch_candidate_cpu_usage"),
        F.count_if("is_online_like").alias("online_task_count"),
        F.count_if("is_deferrable").alias("deferrable_task_count"),
        F.count_if("is_critical").alias("critical_task_count"),
        deferrable_slack.alias("mean_deferrable_slack_us"),
        F.max("dependency_count").alias("max_dependency_count"),
        F.avg("effective_priority").alias("mean_priority"),
        F.avg(F.col("effective_scheduling_class").cast("double")).alias("mean_scheduling_class"),
        *power,
    )
    total = F.col("total_cpu_usage")
    return windows.withColumns(
        {
            "flex_cpu_ratio": positive_share(F.col("flex_cpu_usage"), total),
            "critical_cpu_ratio": positive_share(F.col("critical_cpu_usage"), total),
            "online_cpu_ratio": positive_share(F.col("online_cpu_usage"), total),
        }
    )


def flex_with_power(windows: DataFrame, power_windows: DataFrame) -> DataFrame:
    """Attach power after aggregation.

    Power is unique per window, so this equals joining it to every task first, yet only one row
    per window is moved.
    """
    return windows.drop(*LABEL_COLUMNS).join(power_windows, FLEX_KEYS, "left")


def flex_windows(
    states: DataFrame,
    power_windows: DataFrame | None = None,
    *,
    null_slack_as_zero: bool = False,
) -> DataFrame:
    """The 24-column flex windows.

    Without ``power_windows`` the power carried by the task rows themselves is averaged.
    """
    windows = aggregate_flex(states, null_slack_as_zero)
    if power_windows is not None:
        windows = flex_with_power(windows, power_windows)
    return windows.select(*FLEX_WINDOW_COLUMNS)


def flexibility_table(
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
    rho: float = 1.5,
    max_class: int = 1,
    require_batch_scheduler: bool = True,
    null_slack_as_zero: bool = False,
    min_runtime_us: int = WINDOW_US,
    hot_share: float | None = HOT_SHARE,
) -> DataFrame:
    """Raw tables to flex windows in one plan; no task-level export in between.

    The least runtime of a task is a rule of its own, whatever the width of the windows.
    """
    scope = {"low": low, "high": high, "width_us": width_us}
    states = task_states(
        usage,
        machines,
        collection_events,
        instance_events,
        cell=cell,
        pdus=pdus,
        hot_share=hot_share,
        **scope,
    )
    classified = classify_tasks(task_timing(states, rho, min_runtime_us), max_class, require_batch_scheduler)
    power_windows = power_rollup(select_power(power, None if cell is None else [cell], pdus), **scope)
    return flex_windows(classified, power_windows, null_slack_as_zero=null_slack_as_zero)


# --- summaries -------------------------------------------------------------------------------


def task_state_summary(states: DataFrame) -> DataFrame:
    def rate(flag: str) -> Column:
        return F.avg(F.col(flag).cast("double"))

    return states.agg(
        F.count(F.lit(1)).alias("task_rows"),
        rate("is_flex_candidate").alias("flex_candidate_ratio"),
        rate("is_deferrable").alias("deferrable_ratio"),
        rate("is_critical").alias("critical_ratio"),
        F.count_if("is_online_like").alias("online_like_rows"),
        F.count_if("is_flex_candidate").alias("flex_candidate_rows"),
        F.count_if("is_deferrable").alias("deferrable_rows"),
        F.count_if("is_critical").alias("critical_rows"),
    )


def scheduling_class_mix(states: DataFrame) -> DataFrame:
    return (
        states.groupBy("effective_scheduling_class")
        .agg(F.count(F.lit(1)).alias("task_rows"))
        .orderBy("effective_scheduling_class")
    )


def flex_dataset_summary(windows: DataFrame) -> DataFrame:
    """Row, PDU and index range, five means, three correlations.

    A correlation is NaN below two complete pairs and for a constant side; the built-in ``corr``
    raises on the latter, so it is put together from covariance and deviations.
    """

    def correlation(name: str) -> Column:
        x, y = F.col(name).cast("double"), F.col("measured_power_util").cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        value = F.try_divide(F.covar_pop(x, y), spread)
        return F.coalesce(F.when(F.count_if(both) >= 2, value), F.lit(float("nan")))

    return windows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(F.struct("cell", "pdu")).alias("pdu_count"),
        F.min("window_index").alias("window_index_min"),
        F.max("window_index").alias("window_index_max"),
        F.avg("task_count").alias("mean_task_count"),
        F.avg("total_cpu_usage").alias("mean_total_cpu_usage"),
        F.avg("flex_cpu_ratio").alias("mean_flex_cpu_ratio"),
        F.avg("critical_cpu_ratio").alias("mean_critical_cpu_ratio"),
        F.avg("online_cpu_ratio").alias("mean_online_cpu_ratio"),
        correlation("total_cpu_usage").alias("corr_total_cpu_power"),
        correlation("flex_cpu_ratio").alias("corr_flex_ratio_power"),
        correlation("critical_cpu_ratio").alias("corr_critical_ratio_power"),
    )


def flex_ratio_by_pdu(windows: DataFrame) -> DataFrame:
    return (
        windows.groupBy("cell", "pdu")
        .agg(
            F.avg("flex_cpu_ratio").alias("flex_cpu_ratio"),
            F.avg("critical_cpu_ratio").alias("critical_cpu_ratio"),
            F.avg("online_cpu_ratio").alias("online_cpu_ratio"),
        )
        .orderBy("cell", "pdu")
    )


# --- joining flex windows into a dataset -----------------------------------------------------


def added_flex_columns(dataset_columns: Sequence[str], flex_columns: Sequence[str]) -> list[str]:
    """Output names of the flex columns; a name the dataset already has gets a prefix."""
    taken = set(dataset_columns)
    return [
        f"{FLEX_PREFIX}{name}" if name in taken else name
        for name in flex_columns
        if name not in FLEX_JOIN_KEYS
    ]


def _raise_unless(condition: Column, message: str) -> Column:
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def _unique_keys(df: DataFrame, side: str) -> DataFrame:
    """Fail at run time on a repeated or NULL key; the shuffle and sort are the join's own."""
    per_key = F.count(F.lit(1)).over(Window.partitionBy(*FLEX_JOIN_KEYS))
    valid = F.col("_per_key") == 1
    for key in FLEX_JOIN_KEYS:
        valid = valid & F.col(key).isNotNull()
    message = f"Flex join is not one-to-one: repeated or NULL key in the {side}"
    return df.withColumn("_per_key", per_key).where(_raise_unless(valid, message)).drop("_per_key")


def join_flex_features(dataset: DataFrame, flex: DataFrame, *, check: bool = True) -> DataFrame:
    """Left join on (window_start, cell, pdu), one-to-one, every row matched.

    The checks are part of the plan: they raise while the join runs and cost no second job.
    """
    keys = list(FLEX_JOIN_KEYS)
    dataset, flex = with_utc_time(dataset), with_utc_time(flex)
    names = [c for c in flex.columns if c not in keys]
    added = added_flex_columns(dataset.columns, flex.columns)
    left = dataset
    right = flex.select(*keys, *[F.col(old).alias(new) for old, new in zip(names, added)])
    if check:
        left, right = _unique_keys(left, "dataset"), _unique_keys(right, "flex windows")
    joined = left.join(right, keys, "left").select(*dataset.columns, *added)
    if check:
        present = F.lit(False)
        for name in added:
            present = present | F.col(name).isNotNull()
        joined = joined.where(
            _raise_unless(present, "A dataset row has no flexibility window")
        )
    return joined
