"""Baseline regressors fitted as Spark jobs, scored together in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.operators.evaluate import benchmark_table, leaderboard, regression_metrics
from gridlapse.operators.trees import Forest, fit_forest
from gridlapse.schema import BASELINE_FEATURES, require_columns

FOREST_TREES = 200
FOREST_DEPTH = 8
RIDGE_ALPHA = 1.0

_VECTOR = "_features"


@dataclass(frozen=True)
class Baseline:
    """A fitted baseline: a column expression, or a forest or Spark ML model over some columns."""

    name: str
    features: tuple[str, ...]
    expression: Column | None = None
    model: Model | Forest | None = None

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require_columns(df, self.features, f"columns of {self.name}")
        if self.model is None:
            return df.withColumn(output, self.expression)
        if isinstance(self.model, Forest):
            return self.model.predict(df, output)
        scored = self.model.setPredictionCol(output).transform(_assemble(df, self.features))
        return scored.drop(_VECTOR)


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    vector = array_to_vector(F.array(*[F.col(name).cast("double") for name in features]))
    return df.withColumn(_VECTOR, vector)


def persistence() -> Column:
    return F.col("prev_measured_power_util").cast("double")


def moving_average() -> Column:
    """Mean of lagged power and lagged CPU. The mixed units are the published definition."""
    return (F.col("prev_measured_power_util") + F.col("prev_total_cpu_usage")) / F.lit(2.0)


def cpu_line(train: DataFrame, label: str) -> DataFrame:
    """One row (bias, weight): least squares of the label on total CPU.

    Constant CPU leaves a family of solutions; the one of smallest norm is taken.
    """
    y, x = F.col(label).cast("double"), F.col("total_cpu_usage").cast("double")
    fitted = train.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.avg(y).alias("mean_y"),
        F.avg(x).alias("mean_x"),
        F.var_pop(x).alias("var_x"),
    )
    flat = F.col("slope").isNull() | (F.col("var_x") == 0)
    norm = F.lit(1.0) + F.col("mean_x") * F.col("mean_x")
    return fitted.select(
        F.when(flat, F.col("mean_y") / norm).otherwise(F.col("intercept")).alias("bias"),
        F.when(flat, F.col("mean_y") * F.col("mean_x") / norm)
        .otherwise(F.col("slope"))
        .alias("weight"),
    )


def _varying(train: DataFrame, features: Sequence[str], label: str) -> tuple[list[str], float, int]:
    """Columns that are not constant, the label's deviation and the row count: one small job."""
    row = train.agg(
        *[F.var_pop(F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(features)],
        F.stddev_pop(F.col(label).cast("double")).alias("label_std"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    kept = [f for i, f in enumerate(features) if row[f"v{i}"] and row[f"v{i}"] > 0.0]
    return kept, row["label_std"] or 0.0, row["rows"]


def _fit_linear(train: DataFrame, features: Sequence[str], label: str, alpha: float, name: str):
    kept, label_std, rows = _varying(train, features, label)
    if not kept or label_std == 0.0:
        mean = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        return Baseline(name, tuple(features), F.lit(mean))
    # Spark divides the penalty by the label's deviation and the loss by the number of rows.
    learner = LinearRegression(
        featuresCol=_VECTOR,
        labelCol=label,
        solver="normal",
        elasticNetParam=0.0,
        regParam=alpha * label_std / rows,
        standardization=False,
    )
    return Baseline(name, tuple(kept), model=learner.fit(_assemble(train, kept)))


def fit_baseline(name: str, train: DataFrame, label: str, seed: int = 42, **options) -> Baseline:
    if name not in BASELINE_FEATURES:
        raise ValueError(f"No baseline named {name!r}")
    features = BASELINE_FEATURES[name]
    require_columns(train, [*features, label], f"columns of {name}")
    if name == "persistence":
        return Baseline(name, features, persistence())
    if name == "moving_average":
        return Baseline(name, features, moving_average())
    if name == "cpu_heuristic":
        line = cpu_line(train, label).first()
        return Baseline(
            name, features, F.lit(line["bias"]) + F.lit(line["weight"]) * F.col("total_cpu_usage")
        )
    if name == "linear_regression":
        return _fit_linear(train, features, label, 0.0, name)
    if name == "ridge":
        return _fit_linear(train, features, label, options.get("alpha", RIDGE_ALPHA), name)
    forest = fit_forest(
        train, features, label, trees=options.get("trees", FOREST_TREES), depth=options.get("depth", FOREST_DEPTH), seed=seed
    )
    return Baseline(name, features, model=forest)


#: Training rows of Spark's tree learners: so many in a partition, and the least number of partitions.
TREE_ROWS, TREE_PARTITIONS = 250_000, 32


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for Spark's tree learners: they are bound by CPU, not by reading.

    Input read from files can come in few or uneven partitions, and each tree level waits for the
    slowest. One shuffle of the training rows buys many balanced passes. Bootstrap samples are drawn
    per partition, so rows are dealt by their content into a number of partitions that follows from their number alone,
    and sorted there: the same rows and seed give the same trees.
    """
    content = F.xxhash64(*df.columns)
    partitions = max(TREE_PARTITIONS, -(-df.count() // TREE_ROWS))
    return df.repartition(partitions, content).sortWithinPartitions(content)


def predict_all(
    models: Sequence[Baseline],
    df: DataFrame,
    label: str,
    keep: Sequence[str] = ("split",),
    seed: int = 42,
    family: str = "baseline",
) -> DataFrame:
    """Long prediction table of several models over one scan of ``df``."""
    scored = df
    for i, model in enumerate(models):
        scored = model.predict(scored, f"_p{i}")
    pairs = [
        F.struct(F.lit(m.name).alias("model"), F.col(f"_p{i}").cast("double").alias("prediction"))
        for i, m in enumerate(models)
    ]
    return scored.select(
        *keep, F.col(label).cast("double").alias("y"), F.inline(F.array(*pairs))
    ).withColumns({"seed": F.lit(seed), "family": F.lit(family)})


def fit_and_score(
    dataset: DataFrame,
    label: str = "measured_power_util",
    *,
    holdout: DataFrame | None = None,
    models: Sequence[str] | None = None,
    seed: int = 42,
    **options,
) -> DataFrame:
    """Fit on the train split and return metrics for val and test, and for a holdout table.

    ``dataset`` has a ``split`` column. All models are scored in one job.
    """
    names = list(models) if models else list(BASELINE_FEATURES)
    needed = list(dict.fromkeys([label, *[f for n in names for f in BASELINE_FEATURES[n]]]))
    data = require_columns(dataset, [*needed, "split"]).select("split", *needed)
    train = data.where(F.col("split") == "train")
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = [fit_baseline(name, train, label, seed, **options) for name in names]
    finally:
        train.unpersist()
    scored = data.where(F.col("split").isin("val", "test"))
    if holdout is not None:
        unseen = require_columns(holdout, needed, "holdout columns")
        scored = scored.unionByName(unseen.select(F.lit("holdout").alias("split"), *needed))
    return regression_metrics(
        predict_all(fitted, scored, label, seed=seed), ["family", "model", "seed", "split"]
    )


def baseline_benchmark(metrics: DataFrame) -> DataFrame:
    """Benchmark of val and test, best test MAE first."""
    return leaderboard(benchmark_table(metrics), "test")


def holdout_benchmark(metrics: DataFrame) -> DataFrame:
    """Benchmark of val, test and holdout, best holdout MAE first."""
    return leaderboard(benchmark_table(metrics, ("val", "test", "holdout")), "holdout")
