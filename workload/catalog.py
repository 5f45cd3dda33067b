"""One query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlapse import flows
from gridlapse.functions import buckets, expressions
from gridlapse.operators import (
    baselines,
    coverage,
    evaluate,
    features,
    flex,
    forecast,
    lifecycle,
    rollup,
    sequence,
)
from gridlapse.plans.blocks import Series
from gridlapse.plans.stage import stage
from gridlapse.schema import TASK_STATE_COLUMNS, feature_set
from workload.adapters import DAY, MONTH, Trace

Query = Callable[[SparkSession, str], DataFrame]

LABEL = "measured_power_util"
CONTEXT = 12
SEQUENCE_FEATURES = ("total_cpu_usage", "prev_measured_power_util")
SIMPLE_MODELS = ("persistence", "moving_average", "cpu_heuristic")
STANDARDIZED = tuple(feature_set("legacy"))

TIMED_STATES = (
    "cell",
    "pdu",
    "window_index",
    "collection_id",
    "instance_index",
    "machine_id",
    "avg_cpu_usage",
    "effective_scheduling_class",
    "effective_priority",
    "effective_scheduler",
    "dependency_count",
    "effective_collection_type",
    "submit_time_us",
    "run_start_time_us",
    "run_end_time_us",
    "actual_runtime_us",
    )

QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Engine-neutral output: long integers, microseconds for times, doubles to six places.

    Columns in microseconds stay unrounded: their sums are exact.
    """
    cells = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            cell = F.unix_micros(cell)
        elif isinstance(field.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            cell = cell.cast("long")
        elif isinstance(field.dataType, T.DoubleType) and not field.name.endswith("_us"):
            cell = F.round(cell, 6)
        cells.append(cell.alias(field.name))
    return df.select(*cells)


def query(function: Callable[[Trace], DataFrame]) -> Callable[[Trace], DataFrame]:
    """Register a function of the trace views under its own name."""
    QUERIES[function.__name__] = lambda spark, sf_dir: tidy(function(Trace(spark, sf_dir)))
    return function


def placed(t: Trace) -> DataFrame:
    return rollup.usage_on_machines(t.usage, t.machines)


# --- sources, projections, filters -----------------------------------------------------------


@query
def power_trace_scope(t: Trace) -> DataFrame:
    return rollup.select_power(
        t.power, ["ASIA", "EUROPE", "AFRICA"], ["NATION_0", "NATION_7", "NATION_12", "NATION_13"]
    )


@query
def window_buckets(t: Trace) -> DataFrame:
    return t.usage.select(
        "collection_id",
        "start_time",
        buckets.window_index("start_time").alias("index_5m"),
        buckets.window_index("start_time", DAY).alias("index_1d"),
        buckets.window_start(buckets.window_index("start_time", MONTH), MONTH).alias("start_30d"),
    )


@query
def in_window_range(t: Trace) -> DataFrame:
    inside = buckets.in_window_range("start_time", 9500, 10500, DAY)
    return (
        t.usage.groupBy(inside.alias("inside"))
        .agg(F.count(F.lit(1)).alias("task_rows"), F.min("start_time").alias("first_time"))
    )


@query
def not_in_alloc(t: Trace) -> DataFrame:
    return t.usage.where(expressions.not_in_alloc()).select(
        "collection_id", "instance_index", "machine_id", "alloc_collection_id"
    )


@query
def min_duration(t: Trace) -> DataFrame:
    return t.usage.where(expressions.min_duration(10 * DAY)).select(
        "collection_id", "instance_index", "start_time", "end_time"
    )


@query
def drop_bad_power(t: Trace) -> DataFrame:
    return t.power.where(expressions.good_power())


@query
def select_machines(t: Trace) -> DataFrame:
    return rollup.select_machines(t.machines, "ASIA", ["NATION_2", "NATION_7", "NATION_12"])


@query
def machines_of_pdu(t: Trace) -> DataFrame:
    return rollup.machines_of_pdu(t.machines, "NATION_16")


@query
def nested_projection(t: Trace) -> DataFrame:
    return rollup.cpu_columns(t.usage).select(
        "collection_id", "machine_id", "avg_cpu_usage", "max_cpu_usage"
    )


@query
def zero_defaults(t: Trace) -> DataFrame:
    filled = expressions.zero_defaults(t.usage, ["alloc_collection_id", "collection_type"])
    return filled.select("collection_id", "instance_index", "alloc_collection_id", "collection_type")


@query
def first_present(t: Trace) -> DataFrame:
    return t.trace.select(
        "start_time",
        expressions.first_present(
            ["instance_submit_time", "collection_submit_time", "start_time"], 0
        ).alias("submit_time_us"),
        expressions.first_present(["instance_priority"], -1).alias("priority"),
    )


@query
def coerce_numeric(t: Trace) -> DataFrame:
    text = t.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 5 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("whole"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("real"),
    )
    return expressions.coerce_numeric(text, {"whole": "bigint", "real": "double"})


@query
def calendar_features(t: Trace) -> DataFrame:
    columns = ["hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos"]
    columns += ["day_of_week_sin", "day_of_week_cos"]
    return expressions.calendar_features(t.series).select("cell", "pdu", "window_start", *columns)


@query
def ratio_features(t: Trace) -> DataFrame:
    return expressions.ratio_features(t.series).select(
        "cell", "pdu", "window_start", "cpu_per_machine", "cpu_per_instance", "cpu_spread"
    )


LAGS = ["prev_measured_power_util", "prev_production_power_util", "prev_total_cpu_usage"]


@query
def fill_numeric(t: Trace) -> DataFrame:
    filled = expressions.fill_numeric(features.lag_features(t.series))
    return filled.select("cell", "pdu", "window_start", *LAGS, "delta_total_cpu_usage")


@query
def residual_target(t: Trace) -> DataFrame:
    table = features.build_features(t.series)
    return expressions.residual_target(table, LABEL).select(
        "cell", "pdu", "window_start", f"{LABEL}_residual"
    )


@query
def array_length(t: Trace) -> DataFrame:
    return t.collection_events.select(
        "collection_id",
        "time",
        "type",
        F.array_size("start_after_collection_ids").alias("dependency_count"),
    )


@query
def effective_fields(t: Trace) -> DataFrame:
    return expressions.effective_fields(t.trace).select(
        "start_time",
        "effective_scheduling_class",
        "effective_priority",
        "effective_scheduler",
        "effective_collection_type",
        "dependency_count",
    )


@query
def task_timing(t: Trace) -> DataFrame:
    return expressions.task_timing(t.trace, rho=1.5).select(
        "start_time",
        "submit_time_us",
        "run_start_time_us",
        "run_end_time_us",
        "actual_runtime_us",
        "proxy_deadline_us",
        "remaining_slack_us",
    )


@query
def classify_tasks(t: Trace) -> DataFrame:
    return flex.build_task_states(t.trace).select("start_time", "end_time", *TASK_STATE_COLUMNS)


@query
def classify_tasks_any_scheduler(t: Trace) -> DataFrame:
    states = flex.build_task_states(t.trace, rho=3.0, max_class=2, require_batch_scheduler=False)
    return states.select(
        "start_time", "is_flex_candidate", "is_critical", "is_deferrable", "is_online_like"
    )


# --- joins -----------------------------------------------------------------------------------


@query
def usage_on_machines(t: Trace) -> DataFrame:
    return placed(t).select("cell", "pdu", "machine_id", "collection_id", "start_time", "end_time")


@query
def power_with_usage(t: Trace) -> DataFrame:
    return rollup.power_with_usage(
        rollup.power_rollup(t.power, width_us=3 * DAY),
        rollup.usage_rollup(placed(t), width_us=3 * DAY),
    )


@query
def power_with_usage_exact(t: Trace) -> DataFrame:
    return rollup.power_with_usage_exact(t.power, rollup.usage_rollup_exact(placed(t))).drop(
        "bad_measurement_data", "bad_production_power_data"
    )


@query
def usage_with_priority(t: Trace) -> DataFrame:
    return rollup.usage_with_priority(t.usage, t.instance_events, t.machines)


@query
def restrict_to_collections(t: Trace) -> DataFrame:
    in_asia = rollup.usage_on_machines(t.usage, rollup.select_machines(t.machines, "ASIA"))
    return lifecycle.restrict_to_collections(t.collection_events, in_asia).select(
        "collection_id", "time", "type", "scheduling_class", "priority"
    )


@query
def task_trace(t: Trace) -> DataFrame:
    return lifecycle.task_trace(
        t.usage, t.machines, t.collection_events, t.instance_events, t.power, width_us=DAY
    )


@query
def task_states(t: Trace) -> DataFrame:
    states = lifecycle.task_states(
        t.usage, t.machines, t.collection_events, t.instance_events, width_us=MONTH
    )
    timed = expressions.task_timing(states, 1.5)
    return timed.select(*TIMED_STATES)


def flex_table(t: Trace, **options) -> DataFrame:
    return flex.flexibility_table(
        t.usage,
        t.machines,
        t.collection_events,
        t.instance_events,
        t.power,
        width_us=MONTH,
        **options,
    )


@query
def flex_windows(t: Trace) -> DataFrame:
    return flex_table(t)


@query
def flex_windows_any_scheduler(t: Trace) -> DataFrame:
    return flex_table(t, require_batch_scheduler=False, rho=2.5, null_slack_as_zero=True)


@query
def flex_with_power(t: Trace) -> DataFrame:
    states = flex.build_task_states(t.trace)
    power = t.series.select(
        "window_start",
        F.floor(F.unix_micros("window_start") / F.lit(300_000_000.0)).cast("long").alias("window_index"),
        "cell",
        "pdu",
        LABEL,
        "production_power_util",
    )
    return flex.flex_with_power(flex.aggregate_flex(states), power).select(
        "window_start", "cell", "pdu", "task_count", "flex_cpu_ratio", LABEL, "production_power_util"
    )


@query
def flex_windows_from_trace(t: Trace) -> DataFrame:
    return flex.flex_windows(flex.build_task_states(t.trace), null_slack_as_zero=True)


@query
def join_flex_features(t: Trace) -> DataFrame:
    windows = flex.flex_windows(flex.build_task_states(t.trace))
    return flex.join_flex_features(t.series, windows)


@query
def coverage_join(t: Trace) -> DataFrame:
    return coverage.coverage_join(
        coverage.power_windows(t.power, width_us=DAY), coverage.usage_windows(placed(t), width_us=DAY)
    )


# --- aggregations ----------------------------------------------------------------------------


@query
def usage_rollup(t: Trace) -> DataFrame:
    return rollup.usage_rollup(placed(t), width_us=DAY)


@query
def usage_rollup_exact(t: Trace) -> DataFrame:
    return rollup.usage_rollup_exact(placed(t))


@query
def power_rollup(t: Trace) -> DataFrame:
    return rollup.power_rollup(t.power, width_us=DAY)


@query
def pdu_training_table(t: Trace) -> DataFrame:
    return rollup.pdu_training_table(t.power, t.usage, t.machines, width_us=DAY)


@query
def pdu_training_table_no_alloc(t: Trace) -> DataFrame:
    return rollup.pdu_training_table(
        t.power, t.usage, t.machines, width_us=DAY, exclude_alloc=True
    )


@query
def pdu_training_table_exact(t: Trace) -> DataFrame:
    return rollup.pdu_training_table_exact(t.power, t.usage, t.machines)


@query
def collection_lifecycle(t: Trace) -> DataFrame:
    return lifecycle.collection_lifecycle(t.collection_events, placed(t))


#: A scope of cell, PDUs and windows of a day.
SCOPE = {"cell": "ASIA", "pdus": ["NATION_8", "NATION_9", "NATION_12", "NATION_18"], "low": 8300, "high": 9300}


@query
def task_trace_scope(t: Trace) -> DataFrame:
    return lifecycle.task_trace(
        t.usage, t.machines, t.collection_events, t.instance_events, t.power, width_us=DAY, **SCOPE
    )


@query
def lifecycles_by_cell(t: Trace) -> DataFrame:
    """Two cells that share all collection and instance ids: events of odd times are of the second."""
    cell = F.when(F.col("time") / DAY % 2 < 1, "x").otherwise("y")
    collections = lifecycle.collection_lifecycle(t.collection_events.withColumn("cell", cell))
    instances = lifecycle.instance_lifecycle(t.instance_events.withColumn("cell", cell))
    return instances.select(
        "cell", "collection_id", "instance_index", "instance_submit_time", "instance_end_time", "instance_priority"
    ).join(
        collections.select("cell", "collection_id", "collection_submit_time", "collection_end_time", "collection_priority"),
        ["cell", "collection_id"],
        "left",
    )


@query
def instance_lifecycle(t: Trace) -> DataFrame:
    return lifecycle.instance_lifecycle(t.instance_events, placed(t))


@query
def instance_max_priority(t: Trace) -> DataFrame:
    return rollup.instance_max_priority(t.instance_events)


@query
def distinct_keys(t: Trace) -> DataFrame:
    return lifecycle.distinct_keys(placed(t), ["cell", "pdu", "collection_id"])


@query
def power_range(t: Trace) -> DataFrame:
    return coverage.power_range(t.power)


@query
def join_coverage(t: Trace) -> DataFrame:
    return coverage.join_coverage(t.power, coverage.usage_start_times(placed(t)))


@query
def join_coverage_by_pdu(t: Trace) -> DataFrame:
    return coverage.join_coverage_by_pdu(
        coverage.power_windows(t.power, width_us=3 * DAY),
        coverage.usage_windows(placed(t), width_us=3 * DAY),
    )


@query
def rank_pdu_candidates(t: Trace) -> DataFrame:
    return coverage.rank_pdu_candidates(
        coverage.power_windows(t.power, width_us=7 * DAY),
        coverage.usage_windows(placed(t), width_us=7 * DAY),
    )


@query
def quality_summary(t: Trace) -> DataFrame:
    return coverage.quality_summary(features.lag_features(t.series), "prev_measured_power_util")


@query
def missing_rates(t: Trace) -> DataFrame:
    return coverage.missing_rates(t.trace)


@query
def task_state_summary(t: Trace) -> DataFrame:
    return flex.task_state_summary(flex.build_task_states(t.trace))


@query
def scheduling_class_mix(t: Trace) -> DataFrame:
    return flex.scheduling_class_mix(flex.build_task_states(t.trace))


@query
def flex_dataset_summary(t: Trace) -> DataFrame:
    return flex.flex_dataset_summary(flex.flex_windows(flex.build_task_states(t.trace)))


@query
def flex_ratio_by_pdu(t: Trace) -> DataFrame:
    return flex.flex_ratio_by_pdu(flex.flex_windows(flex.build_task_states(t.trace)))


# --- windows and sequences -------------------------------------------------------------------


@query
def lag_features(t: Trace) -> DataFrame:
    return features.lag_features(t.series).select(
        "cell", "pdu", "window_start", *LAGS, "delta_total_cpu_usage"
    )


@query
def lag_features_of_production(t: Trace) -> DataFrame:
    lagged = features.lag_features(t.series, "production_power_util", Series(block_us=3 * DAY))
    return lagged.select("cell", "pdu", "window_start", *LAGS, "delta_total_cpu_usage")


@query
def build_features(t: Trace) -> DataFrame:
    return features.build_features(t.series)


def built(t: Trace) -> DataFrame:
    """Feature table, computed once for the several jobs that read it."""
    return stage(features.build_features(t.series), "features")


def dataset(t: Trace) -> DataFrame:
    return features.chronological_split(built(t))


@query
def chronological_split(t: Trace) -> DataFrame:
    split = features.chronological_split(t.series)
    return split.select("cell", "pdu", "window_start", LABEL, "split")


@query
def split_counts(t: Trace) -> DataFrame:
    return coverage.split_counts(features.chronological_split(t.series))


@query
def split_bounds(t: Trace) -> DataFrame:
    return features.split_bounds(t.series)


def _columns_of_context(windows: DataFrame, depth: int, names: Sequence[str]) -> list:
    return [
        F.col("context")[step][i].alias(f"{name}_{depth - step:02d}")
        for step in range(depth)
        for i, name in enumerate(names)
    ]


@query
def sequence_windows(t: Trace) -> DataFrame:
    windows = sequence.sequence_windows(
        features.build_features(t.series), SEQUENCE_FEATURES, LABEL, CONTEXT
    )
    cells = _columns_of_context(windows, CONTEXT, ("cpu", "power"))
    return windows.select("cell", "pdu", "window_start", "target", *cells)


@query
def with_history(t: Trace) -> DataFrame:
    data = dataset(t)
    history = data.where(F.col("split") != "test").drop("split")
    target = data.where(F.col("split") == "test").drop("split")
    rows = sequence.with_history(target, history)
    windows = sequence.sequence_windows(
        rows, SEQUENCE_FEATURES, LABEL, CONTEXT, carry_columns=["prev_measured_power_util"]
    )
    return windows.select(
        "cell",
        "pdu",
        "window_start",
        "target",
        F.col("prev_measured_power_util").alias("anchor"),
        F.col("context")[0][0].alias("oldest_cpu"),
        F.col("context")[CONTEXT - 1][0].alias("newest_cpu"),
    )


@query
def common_rows(t: Trace) -> DataFrame:
    rows = sequence.common_rows(features.build_features(t.series), CONTEXT)
    return rows.select("cell", "pdu", "window_start", LABEL, "prev_measured_power_util")


@query
def sequence_targets(t: Trace) -> DataFrame:
    return sequence.sequence_targets(
        features.build_features(t.series), "prev_measured_power_util", CONTEXT
    )


@query
def flatten_lags(t: Trace) -> DataFrame:
    windows = sequence.sequence_windows(
        features.build_features(t.series), SEQUENCE_FEATURES, LABEL, 3
    )
    flat = sequence.flatten_lags(windows).withColumn("_flat", vector_to_array("features"))
    return flat.select(
        "cell", "pdu", "window_start", *[F.col("_flat")[i].alias(f"x{i}") for i in range(6)]
    )


# --- ordering and set operations -------------------------------------------------------------


@query
def sample_power_trace(t: Trace) -> DataFrame:
    return rollup.sample_power_trace(t.power, 288)


@query
def ordered_export(t: Trace) -> DataFrame:
    table = rollup.pdu_training_table(t.power, t.usage, t.machines, width_us=7 * DAY)
    return table.orderBy("cell", "pdu", "window_start")


@query
def union_of_splits(t: Trace) -> DataFrame:
    data = features.chronological_split(t.series)
    train, val = (data.where(F.col("split") == s) for s in ("train", "val"))
    return sequence.with_history(val, train).select(
        "cell", "pdu", "window_start", "split", F.col(sequence.IS_TARGET).alias("is_target")
    )


# --- models and evaluation -------------------------------------------------------------------


@query
def fit_standardizer(t: Trace) -> DataFrame:
    train = dataset(t).where(F.col("split") == "train")
    stats = sequence.fit_standardizer(train, STANDARDIZED, LABEL, CONTEXT)
    return stats.select("column_name", "role", "mean", "std")


@query
def apply_standardizer(t: Trace) -> DataFrame:
    table = built(t)
    scaler = sequence.load_standardizer(
        sequence.fit_standardizer(table, SEQUENCE_FEATURES, LABEL, 3)
    )
    raw = sequence.sequence_windows(table, SEQUENCE_FEATURES, LABEL, 3)
    scaled = sequence.apply_standardizer(raw, scaler)
    restored = sequence.invert_targets(scaled, scaler, "target", "restored")
    cells = _columns_of_context(scaled, 3, ("cpu", "power"))
    return restored.select("cell", "pdu", "window_start", "target", "restored", *cells)


def predictions(t: Trace, models: Sequence[str] = SIMPLE_MODELS) -> DataFrame:
    data = dataset(t)
    train = data.where(F.col("split") == "train")
    fitted = [baselines.fit_baseline(name, train, LABEL) for name in models]
    return baselines.predict_all(fitted, data, LABEL, ["cell", "pdu", "window_start", "split"])


def runs(t: Trace) -> DataFrame:
    """Metrics per PDU. The PDU number stands for the seed of a repeated run."""
    scored = predictions(t).withColumns(
        {
            "seed": F.substring("pdu", 4, 1).cast("long"),
            "family": F.when(F.col("model") == "cpu_heuristic", "deep").otherwise("baseline"),
        }
    )
    return evaluate.regression_metrics(scored, ["family", "model", "seed", "split"])


@query
def persistence(t: Trace) -> DataFrame:
    return predictions(t, ["persistence"]).drop("seed", "family")


@query
def moving_average(t: Trace) -> DataFrame:
    return predictions(t, ["moving_average"]).drop("seed", "family")


@query
def cpu_heuristic(t: Trace) -> DataFrame:
    return predictions(t, ["cpu_heuristic"]).drop("seed", "family")


@query
def regression_metrics(t: Trace) -> DataFrame:
    return evaluate.regression_metrics(predictions(t), ["model", "split"])


@query
def metrics_long(t: Trace) -> DataFrame:
    by = ["model", "seed", "split"]
    return evaluate.metrics_long(runs(t), by)


@query
def run_summary(t: Trace) -> DataFrame:
    return evaluate.run_summary(runs(t))


def _side(t: Trace, model: str) -> DataFrame:
    return runs(t).where((F.col("model") == model) & (F.col("split") == "test"))


@query
def runs_by_seed(t: Trace) -> DataFrame:
    return evaluate.runs_by_seed(_side(t, "cpu_heuristic"), _side(t, "persistence"))


@query
def winner_counts(t: Trace) -> DataFrame:
    return evaluate.winner_counts(_side(t, "cpu_heuristic"), _side(t, "persistence"))


@query
def member_metric_mean(t: Trace) -> DataFrame:
    return evaluate.member_metric_mean(runs(t), ["model", "split"])


@query
def ensemble_mean(t: Trace) -> DataFrame:
    return evaluate.ensemble_mean(predictions(t), ["cell", "pdu", "window_start", "split"])


@query
def leaderboard(t: Trace) -> DataFrame:
    return evaluate.leaderboard(evaluate.benchmark_table(runs(t)))


@query
def best_per_family(t: Trace) -> DataFrame:
    return evaluate.best_per_family(evaluate.benchmark_table(runs(t)))


@query
def best_gap(t: Trace) -> DataFrame:
    return evaluate.best_gap(evaluate.benchmark_table(runs(t)), "deep")


@query
def compare_models(t: Trace) -> DataFrame:
    table = evaluate.benchmark_table(runs(t))
    deep = table.where(F.col("family") == "deep").withColumn("context_length", F.lit(CONTEXT))
    return evaluate.compare_models(table.where(F.col("family") == "baseline"), deep)


@query
def stability_table(t: Trace) -> DataFrame:
    return evaluate.stability_table(runs(t), ["cpu_heuristic", "persistence"], ["val", "test"])


# --- fitted learners -------------------------------------------------------------------------


@query
def training_dataset(t: Trace) -> DataFrame:
    """Raw tables to split features in one flow."""
    data = flows.training_dataset(
        t.power, t.usage, t.machines, width_us=DAY
    )
    return data.select(
        "cell", "pdu", "window_start", LABEL, "prev_measured_power_util", "cpu_per_machine", "split"
    )


def _solved(t: Trace, model: str) -> DataFrame:
    """Two solvers agree to about ten places; four are compared."""
    scored = predictions(t, [model]).drop("seed", "family")
    return scored.withColumn("prediction", F.round("prediction", 4))


@query
def linear_regression(t: Trace) -> DataFrame:
    return _solved(t, "linear_regression")


@query
def ridge(t: Trace) -> DataFrame:
    return _solved(t, "ridge")


# --- learners without an SQL form: rows only, tested apart -----------------------------------


@query
def random_forest(t: Trace) -> DataFrame:
    data = dataset(t)
    train = data.where(F.col("split") == "train")
    model = baselines.fit_baseline("random_forest", train, LABEL, seed=42)
    scored = baselines.predict_all([model], data, LABEL, ["cell", "pdu", "window_start", "split"])
    return scored.withColumn("prediction", F.round("prediction", 4))


def _holdout_parts(t: Trace) -> tuple[DataFrame, DataFrame]:
    """Series of one cell to develop on, series of the other as unseen holdout."""
    table = built(t)
    develop = features.chronological_split(table.where(F.col("cell") == "c0"))
    return develop, table.where(F.col("cell") == "c1")


@query
def fit_and_score(t: Trace) -> DataFrame:
    develop, holdout = _holdout_parts(t)
    metrics = baselines.fit_and_score(develop, LABEL, holdout=holdout)
    return baselines.holdout_benchmark(metrics)


@query
def score_simple_models(t: Trace) -> DataFrame:
    """The whole path of fitting and scoring, for the models that SQL can follow."""
    metrics = baselines.fit_and_score(dataset(t), LABEL, models=SIMPLE_MODELS)
    return metrics.select("model", "split", "sample_count", "mae", "rmse", "mape", "smape", "r2")


@query
def sequence_regressor(t: Trace) -> DataFrame:
    data = dataset(t)
    train = data.where(F.col("split") == "train").drop("split")
    spec = forecast.SequenceSpec(features=tuple(feature_set("legacy")))
    scored = forecast.score_splits(forecast.fit_sequence_regressor(train, spec), data)
    return scored.withColumn("prediction", F.round("prediction", 4))


@query
def score_holdout(t: Trace) -> DataFrame:
    develop, holdout = _holdout_parts(t)
    spec = forecast.SequenceSpec(features=tuple(feature_set("legacy")))
    train = develop.where(F.col("split") == "train").drop("split")
    return forecast.score_holdout(forecast.fit_sequence_regressor(train, spec), holdout)


@query
def seed_stability(t: Trace) -> DataFrame:
    develop, holdout = _holdout_parts(t)
    spec = forecast.SequenceSpec(features=tuple(feature_set("legacy")), learner="gbt")
    report = forecast.seed_stability(develop, holdout, spec)
    return report.per_seed

