"""Sequence regressor: predict a window's power from the rows before it."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.functions.expressions import residual_target
from gridlapse.operators.baselines import fit_and_score, spread
from gridlapse.operators.evaluate import (
    ensemble_mean,
    member_metric_mean,
    regression_metrics,
    run_summary,
    stability_table,
    winner_counts,
)
from gridlapse.operators.lagged import LagModel, fit_lagged
from gridlapse.operators.sequence import (
    IS_TARGET,
    Standardizer,
    apply_standardizer,
    fit_standardizer,
    flatten_lags,
    load_standardizer,
    sequence_windows,
    with_history,
)
from gridlapse.plans.blocks import Series
from gridlapse.plans.stage import path_exists
from gridlapse.schema import DEFAULT_SEEDS, METRICS, feature_set

ANCHOR = "prev_measured_power_util"
#: Learners; the linear one is fitted and scored without windows.
LOADERS = {"linear": None, "gbt": GBTRegressionModel, "forest": RandomForestRegressionModel}
PENALTY = 1e-6


@dataclass(frozen=True)
class SequenceSpec:
    """What the regressor sees and predicts."""

    label: str = "measured_power_util"
    features: tuple[str, ...] = tuple(feature_set("enhanced"))
    context_length: int = 12
    target_mode: str = "residual"
    target_scaling: str = "standard"
    learner: str = "linear"
    series: Series = Series()

    def __post_init__(self) -> None:
        if self.target_mode not in ("absolute", "residual"):
            raise ValueError(f"No target mode named {self.target_mode!r}")
        if self.target_scaling not in ("standard", "none"):
            raise ValueError(f"No target scaling named {self.target_scaling!r}")
        if self.learner not in LOADERS:
            raise ValueError(f"No learner named {self.learner!r}")

    @property
    def residual(self) -> bool:
        return self.target_mode == "residual"

    @property
    def target(self) -> str:
        return f"{self.label}_residual" if self.residual else self.label

    def prepare(self, df: DataFrame) -> DataFrame:
        return residual_target(df, self.label, ANCHOR) if self.residual else df

    def rows(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Target rows and those that only give context, told apart."""
        return with_history(self.prepare(df), None if history is None else self.prepare(history))

    def windows(
        self, df: DataFrame, history: DataFrame | None, standardizer: Standardizer
    ) -> DataFrame:
        """Scaled, flattened windows of ``df``'s rows with the anchor of each target."""
        raw = sequence_windows(
            self.rows(df, history),
            self.features,
            self.target,
            self.context_length,
            carry_columns=[ANCHOR] if self.residual else [],
            series=self.series,
        )
        return flatten_lags(apply_standardizer(raw, standardizer)).drop("context")


@dataclass(frozen=True)
class SequenceRegressor:
    spec: SequenceSpec
    standardizer: Standardizer
    model: Model | LagModel

    def predict(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(cell, pdu, window_start, y, prediction) in units of the label."""
        if isinstance(self.model, LagModel):
            return self.predict_rows(self.spec.rows(df, history))
        return self.predict_windows(self.spec.windows(df, history, self.standardizer))

    def predict_rows(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Predictions of the linear learner for all target rows with enough rows before them."""
        spec, scale = self.spec, self.standardizer
        used = [*spec.series.keys, spec.series.order, spec.target, *spec.features, *keep, IS_TARGET]
        numbers = rows.select(*dict.fromkeys([*used, *([ANCHOR] if spec.residual else [])]))
        scored = self.model.score(numbers, scale.scaled_features(), spec.series).where(F.col(IS_TARGET))
        return self._in_label(scored.withColumn("target", scale.scale_target(F.col(spec.target).cast("double"))), keep)

    def predict_windows(self, windows: DataFrame, *keep: str) -> DataFrame:
        if isinstance(self.model, LagModel):
            return self._in_label(windows.withColumn("prediction", self.model.of_vector("features")), keep)
        return self._in_label(self.model.transform(windows), keep)

    def _in_label(self, scored: DataFrame, keep: Sequence[str]) -> DataFrame:
        anchor = F.col(ANCHOR) if self.spec.residual else F.lit(0.0)
        return scored.select(
            *self.spec.series.keys,
            self.spec.series.order,
            *keep,
            (self.standardizer.invert_target(F.col("target")) + anchor).alias("y"),
            (self.standardizer.invert_target(F.col("prediction")) + anchor).alias("prediction"),
        )

    def save(self, path: str) -> None:
        """A one-row JSON dataset with the spec, the standardizer and a linear model; others are Spark ML models beside it."""
        linear = isinstance(self.model, LagModel)
        if not linear:
            self.model.write().overwrite().save(f"{path}/model")
        payload = json.dumps(
            {"spec": asdict(self.spec), "standardizer": asdict(self.standardizer), "linear": asdict(self.model) if linear else None}
        )
        SparkSession.getActiveSession().createDataFrame([(payload,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SequenceRegressor:
        raw = json.loads(spark.read.text(f"{path}/settings").first()[0])
        settings = raw["spec"]
        series = settings.pop("series")
        series["keys"] = tuple(series["keys"])
        settings["features"] = tuple(settings["features"])
        spec = SequenceSpec(**settings, series=Series(**series))
        standardizer = Standardizer.from_json(json.dumps(raw["standardizer"]))
        if raw["linear"]:
            return SequenceRegressor(spec, standardizer, LagModel(raw["linear"]["bias"], tuple(map(tuple, raw["linear"]["weights"]))))
        return SequenceRegressor(spec, standardizer, LOADERS[spec.learner].load(f"{path}/model"))


def _learner(spec: SequenceSpec, seed: int):
    common = {"featuresCol": "features", "labelCol": "target"}
    if spec.learner == "gbt":
        return GBTRegressor(**common, maxIter=20, maxDepth=4, subsamplingRate=0.8, seed=seed)
    return RandomForestRegressor(**common, numTrees=50, maxDepth=8, seed=seed)


def _training_windows(train: DataFrame, spec: SequenceSpec, standardizer: Standardizer) -> DataFrame:
    """Persisted input of a learner, which passes over it several times.

    Blocks that do not fit in memory go to disk.
    """
    windows = spec.windows(train, None, standardizer).select("features", "target")
    return spread(windows).persist(StorageLevel.MEMORY_AND_DISK)


def fit_linear(train: DataFrame, spec: SequenceSpec, standardizer: Standardizer) -> LagModel:
    """Least squares over all windows of ``train``, from sums of lagged cross products."""
    columns = [c.alias(f"x{i}") for i, c in enumerate(standardizer.scaled_features())]
    target = standardizer.scale_target(F.col(spec.target).cast("double")).alias("target")
    rows = spec.prepare(train).select(*spec.series.keys, spec.series.order, *columns, target)
    names = [f"x{i}" for i in range(len(columns))]
    return fit_lagged(rows, names, "target", spec.context_length, penalty=PENALTY, series=spec.series)


def fit_scaling(train: DataFrame, spec: SequenceSpec) -> Standardizer:
    stats = fit_standardizer(
        spec.prepare(train), spec.features, spec.target, spec.context_length, series=spec.series
    )
    standardizer = load_standardizer(stats)
    return standardizer if spec.target_scaling == "standard" else standardizer.without_target_scaling()


def fit_sequence_regressor(
    train: DataFrame, spec: SequenceSpec = SequenceSpec(), seed: int = 42
) -> SequenceRegressor:
    standardizer = fit_scaling(train, spec)
    if spec.learner == "linear":
        return SequenceRegressor(spec, standardizer, fit_linear(train, spec, standardizer))
    windows = _training_windows(train, spec, standardizer)
    try:
        return SequenceRegressor(spec, standardizer, _learner(spec, seed).fit(windows))
    finally:
        windows.unpersist()


def _split_rows(dataset: DataFrame, spec: SequenceSpec) -> DataFrame:
    """All rows, tagged ``_split``; those of val and test are targets, each with all earlier splits as history.

    The splits follow each other in time, so the rows before a window are the same rows whether or
    not the later splits are present: one pass over the whole dataset serves both.
    """
    tagged = dataset.withColumnRenamed("split", "_split")
    rows = tagged.where(F.col("_split").isin("train", "val", "test"))
    return spec.prepare(rows.withColumn(IS_TARGET, F.col("_split").isin("val", "test")))


def split_windows(dataset: DataFrame, spec: SequenceSpec, standardizer: Standardizer) -> DataFrame:
    """Windows of the val and test rows, each with all earlier splits as history."""
    raw = sequence_windows(
        _split_rows(dataset, spec),
        spec.features,
        spec.target,
        spec.context_length,
        carry_columns=["_split", *([ANCHOR] if spec.residual else [])],
        series=spec.series,
    )
    scaled = flatten_lags(apply_standardizer(raw, standardizer)).drop("context")
    return scaled.withColumnRenamed("_split", "split")


def score_splits(regressor: SequenceRegressor, dataset: DataFrame) -> DataFrame:
    """Predictions for the val and test rows of a split dataset."""
    if isinstance(regressor.model, LagModel):
        rows = _split_rows(dataset, regressor.spec)
        return regressor.predict_rows(rows, "_split").withColumnRenamed("_split", "split")
    windows = split_windows(dataset, regressor.spec, regressor.standardizer)
    return regressor.predict_windows(windows, "split")


def score_holdout(regressor: SequenceRegressor, holdout: DataFrame) -> DataFrame:
    """Metrics and sample count on a table of unseen series; no history is added."""
    predictions = regressor.predict(holdout).withColumn("split", F.lit("holdout"))
    return regression_metrics(predictions, ["split"])


def ensemble_report(
    predictions: DataFrame, key: Sequence[str], by: Sequence[str] = ("split",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics per member, mean of the members' metrics, metrics of the mean prediction)."""
    members = regression_metrics(predictions, [*by, "model", "seed"])
    combined = ensemble_mean(predictions, list(dict.fromkeys([*key, *by])))
    return members, member_metric_mean(members, by), regression_metrics(combined, list(by))


@dataclass(frozen=True)
class StabilityReport:
    metrics: DataFrame
    per_seed: DataFrame
    summary: DataFrame
    winners: DataFrame


METRIC_COLUMNS = ("family", "model", "seed", "split", "sample_count", *METRICS)


METRIC_SCHEMA = "family string, model string, seed long, split string, sample_count long, " + ", ".join(f"{m} double" for m in METRICS)


def _stored_seeds(spark: SparkSession, store: str | None) -> list[tuple]:
    """Metric rows of the seeds that an earlier call finished."""
    if store is None or not path_exists(spark, store):
        return []
    return [tuple(r) for r in spark.read.schema(METRIC_SCHEMA).parquet(f"{store}/seed-*").collect()]


def _each_seed(spark: SparkSession, wanted: Sequence[int], run: Callable[[int], list[tuple]], parallel: int) -> list[tuple]:
    """Rows of all seeds, each worked on in a scheduler pool of its own, ``parallel`` at a time.

    A seed that fails doesn't stop the others; its error is raised when they are done.
    """

    def in_pool(seed: int) -> list[tuple]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"seed-{seed}")
        return run(seed)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as threads:
        # What is staged inside a block goes there from the threads, too.
        work = [threads.submit(copy_context().run, in_pool, seed) for seed in wanted]
    rows, errors = [], []
    for seed, done in zip(wanted, work):
        if done.exception() is None:
            rows += done.result()
        else:
            errors.append((seed, done.exception()))
    if errors:
        raise RuntimeError(f"Seeds {[seed for seed, _ in errors]} failed; the others are finished") from errors[0][1]
    return rows


def seed_stability(
    dataset: DataFrame,
    holdout: DataFrame,
    spec: SequenceSpec = SequenceSpec(),
    *,
    seeds: Sequence[int] = DEFAULT_SEEDS,
    baselines: Sequence[str] = ("random_forest",),
    done: DataFrame | None = None,
    store: str | None = None,
    parallel: int = 2,
    name: str = "sequence",
    **options,
) -> StabilityReport:
    """Repeat fit and evaluation per seed and summarize.

    Each fit is a distributed job; ``parallel`` threads submit those of as many seeds at a time, each to a pool of its
    own, which a session with FAIR scheduling shares evenly. Windows do not depend on
    the seed and are built once. A run leaves one metric row per model and split, and only those
    rows are brought back. With ``store``, a folder, they are written as each seed ends, and
    seeds found there are skipped; so are those of ``done``, metric rows of an earlier call.
    The linear learner doesn't use its seed, so several seeds of it are refused.
    """
    if spec.learner == "linear" and len(set(seeds)) > 1:
        raise ValueError("The linear learner is the same for every seed; choose gbt or forest")
    spark = dataset.sparkSession
    rows = [] if done is None else [tuple(r) for r in done.select(*METRIC_COLUMNS).collect()]
    known = {row[METRIC_COLUMNS.index("seed")] for row in rows}
    rows += [row for row in _stored_seeds(spark, store) if row[METRIC_COLUMNS.index("seed")] not in known and row[METRIC_COLUMNS.index("seed")] in seeds]
    finished = {row[METRIC_COLUMNS.index("seed")] for row in rows}
    wanted = [seed for seed in dict.fromkeys(seeds) if seed not in finished]
    train = dataset.where(F.col("split") == "train").drop("split")
    kept = []
    try:
        if wanted:
            scaling = fit_scaling(train, spec)
            on_train = None if spec.learner == "linear" else _training_windows(train, spec, scaling)
            unseen = spec.windows(holdout, None, scaling).withColumn("split", F.lit("holdout"))
            scored = split_windows(dataset, spec, scaling).unionByName(unseen)
            kept = [df for df in (on_train, scored.persist(StorageLevel.MEMORY_AND_DISK)) if df is not None]

        def run(seed: int) -> list[tuple]:
            fitted = fit_linear(train, spec, scaling) if on_train is None else _learner(spec, seed).fit(on_train)
            model = SequenceRegressor(spec, scaling, fitted)
            deep = regression_metrics(model.predict_windows(scored, "split"), ["split"])
            deep = deep.withColumns(
                {"family": F.lit("deep"), "model": F.lit(name), "seed": F.lit(seed)}
            )
            plain = fit_and_score(
                dataset, spec.label, holdout=holdout, models=baselines, seed=seed, **options
            )
            found = [tuple(r) for r in deep.select(*METRIC_COLUMNS).unionByName(plain.select(*METRIC_COLUMNS)).collect()]
            if store is not None:
                spark.createDataFrame(found, METRIC_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{store}/seed-{seed}")
            return found

        rows += _each_seed(spark, wanted, run, parallel)
    finally:
        for df in kept:
            df.unpersist()
    metrics = spark.createDataFrame(rows, METRIC_SCHEMA)
    on_holdout = metrics.where(F.col("split") == "holdout")
    return StabilityReport(
        metrics,
        stability_table(metrics, [name, *baselines]),
        run_summary(metrics.where(F.col("split").isin("test", "holdout"))),
        winner_counts(
            on_holdout.where(F.col("model") == name),
            on_holdout.where(F.col("model") == baselines[0]),
        ),
    )
