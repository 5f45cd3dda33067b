"""Regression metrics, leaderboards, ensembles and comparisons of runs.

The common shape is the long prediction table ``(family, model, seed, split, y, prediction, ...)``;
metrics are one aggregate over it whatever the number of models, seeds and rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.schema import METRICS

EPS = 1e-8
SUMMARY_METRICS = ("mae", "rmse", "r2")
TRUTH_ATOL = 1e-6
TRUTH_RTOL = 1e-5


def metric_columns(y: str = "y", prediction: str = "prediction") -> dict[str, Column]:
    """The five metrics as aggregate expressions of a single pass.

    The total sum of squares comes from the one-pass population variance, which is merged
    centrally and needs no second scan for the mean.
    """
    truth = F.col(y).cast("double")
    error = truth - F.col(prediction).cast("double")
    size = F.abs(truth)
    both = size + F.abs(F.col(prediction).cast("double"))
    squared = F.sum(error * error)
    total = F.var_pop(truth) * F.count(truth)
    measures = {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.abs(error) / F.greatest(size, F.lit(EPS))),
        "smape": F.avg(F.lit(2.0) * F.abs(error) / F.greatest(both, F.lit(EPS))),
        "r2": F.when(total <= F.lit(EPS), F.lit(0.0)).otherwise(
            F.lit(1.0) - squared / F.nullif(total, F.lit(0.0))
        ),
    }
    # A row without truth or prediction must not make a model look better than it is.
    complete = F.count_if(error.isNull() | F.isnan(error)) == 0
    return {name: F.when(complete, c).otherwise(F.lit(math.nan)) for name, c in measures.items()}


def regression_metrics(
    predictions: DataFrame,
    by: Sequence[str] = ("model", "seed", "split"),
    y: str = "y",
    prediction: str = "prediction",
) -> DataFrame:
    """One row per group: sample_count, mae, rmse, mape, smape, r2."""
    measures = [c.alias(name) for name, c in metric_columns(y, prediction).items()]
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"), *measures)


def metrics_long(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """(…by, metric, value): one row per group and metric."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]
    return metrics.select(*by, F.inline(F.array(*pairs)))


def benchmark_table(metrics: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """One row per run, metrics of each split side by side as ``<split>_<metric>``."""
    keys = [name for name in ("family", "model", "seed") if name in metrics.columns]
    cells = [
        F.max(F.when(F.col("split") == split, F.col(name))).alias(f"{split}_{name}")
        for split in splits
        for name in METRICS
    ]
    return metrics.where(F.col("split").isin(list(splits))).groupBy(*keys).agg(*cells)


def _by_quality(split: str, with_r2: bool) -> list[Column]:
    order = [F.col(f"{split}_mae").asc_nulls_last(), F.col(f"{split}_rmse").asc_nulls_last()]
    if with_r2:
        order.append(F.col(f"{split}_r2").desc_nulls_last())
    return [*order, F.col("model").asc()]


def leaderboard(benchmark: DataFrame, split: str = "test", with_r2: bool = False) -> DataFrame:
    """Best run first: MAE, then RMSE, then (for comparisons) R2."""
    return benchmark.orderBy(*_by_quality(split, with_r2))


def best_per_family(benchmark: DataFrame, split: str = "test") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("family").orderBy(*_by_quality(split, True)))
    return benchmark.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def best_gap(
    benchmark: DataFrame, family: str, versus: str = "baseline", split: str = "test"
) -> DataFrame:
    """Best run of one family against the best of another: names and metric differences."""
    best = best_per_family(benchmark, split)

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("family") == side, F.col(column)))

    return best.agg(
        of(family, "model").alias("best_model"),
        of(versus, "model").alias("versus_model"),
        *[
            (of(family, f"{split}_{m}") - of(versus, f"{split}_{m}")).alias(f"{split}_{m}_gap")
            for m in SUMMARY_METRICS
        ],
    )


def compare_models(baseline: DataFrame, deep: DataFrame, split: str = "test") -> DataFrame:
    """One sorted table over both families; columns only one side has are NULL on the other."""
    tagged = [
        runs if "family" in runs.columns else runs.withColumn("family", F.lit(family))
        for runs, family in ((baseline, "baseline"), (deep, "deep"))
    ]
    return leaderboard(
        tagged[0].unionByName(tagged[1], allowMissingColumns=True), split, with_r2=True
    )


# --- repeated runs ---------------------------------------------------------------------------


def run_summary(metrics: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Mean and population deviation over seeds."""
    cells = []
    for name in SUMMARY_METRICS:
        cells += [
            F.avg(name).alias(f"{name}_mean"),
            F.stddev_pop(name).alias(f"{name}_std"),
        ]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *cells)


def runs_by_seed(
    deep: DataFrame, baseline: DataFrame, how: str = "inner", prefix: str = "baseline"
) -> DataFrame:
    """Deep runs next to the baseline runs of the same seed."""
    renamed = baseline.select(
        "seed",
        F.col("model").alias(f"{prefix}_model"),
        *[F.col(m).alias(f"{prefix}_{m}") for m in SUMMARY_METRICS],
    )
    return deep.select("seed", "model", *SUMMARY_METRICS).join(renamed, "seed", how)


def winner_counts(deep: DataFrame, baseline: DataFrame) -> DataFrame:
    """Seeds in which the deep run is strictly better; seeds without both runs are skipped."""
    paired = runs_by_seed(deep, baseline)
    return paired.agg(
        F.count_if(F.col("mae") < F.col("baseline_mae")).alias("mae_wins"),
        F.count_if(F.col("rmse") < F.col("baseline_rmse")).alias("rmse_wins"),
        F.count_if(F.col("r2") > F.col("baseline_r2")).alias("r2_wins"),
        F.count(F.lit(1)).alias("seeds"),
    )


def stability_table(
    metrics: DataFrame, models: Sequence[str], splits: Sequence[str] = ("test", "holdout")
) -> DataFrame:
    """One row per seed, a column per model, split and metric."""
    cells = [
        F.max(F.when((F.col("model") == m) & (F.col("split") == s), F.col(name))).alias(
            f"{m}_{s}_{name}"
        )
        for m in models
        for s in splits
        for name in SUMMARY_METRICS
    ]
    return metrics.groupBy("seed").agg(*cells).orderBy("seed")


# --- ensembles -------------------------------------------------------------------------------


def ensemble_mean(
    predictions: DataFrame,
    key: Sequence[str],
    *,
    members: int | None = None,
    atol: float = TRUTH_ATOL,
    rtol: float = TRUTH_RTOL,
) -> DataFrame:
    """Mean prediction over members per row key.

    Fails while running if the members' truths differ or aren't numbers, or if a row lacks a member
    or has one twice. ``members`` is their number; by default the different models and seeds.
    """
    names = [name for name in ("family", "model", "seed") if name in predictions.columns]
    # A member's number; their sum tells a row that has one twice and lacks another.
    number = F.pmod(F.xxhash64(*names), F.lit(1 << 40)) if names else F.lit(0).cast("long")
    if names:
        every = predictions.select(*names).distinct()
        known = every.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(number).alias("numbers"))).scalar()
        expected, whole = known["n"] if members is None else F.lit(members), known["numbers"]
    else:
        expected, whole = F.count(F.lit(1)) if members is None else F.lit(members), F.sum(number)
    spread = F.max("y") - F.min("y")
    numbers = F.count_if(F.col("y").isNull() | F.isnan("y")) == 0
    agree = numbers & (spread <= F.lit(atol) + F.lit(rtol) * F.abs(F.max("y")))
    mismatch = F.raise_error(F.lit("Ensemble members disagree on the true value of a row"))
    missing = F.raise_error(F.lit("A row lacks an ensemble member's prediction or has it twice"))
    full = (F.count("prediction") == expected) & (F.count(F.lit(1)) == expected) & (F.sum(number) == whole)
    mean = F.when(~agree, mismatch.cast("double")).when(~full, missing.cast("double")).otherwise(F.avg("prediction"))
    return predictions.groupBy(*key).agg(
        F.max("y").alias("y"), mean.alias("prediction"), F.count(F.lit(1)).alias("member_count")
    )


def member_metric_mean(metrics: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("member_count"), *[F.avg(m).alias(m) for m in METRICS]
    )
