"""Context windows over series, and the standardizer fitted on them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.plans.blocks import Series, drop_helpers, prior_rows, with_carry, with_position
from gridlapse.schema import require_columns

IS_TARGET = "_is_target"
MIN_STD = 1e-6


def with_history(target: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Target rows plus rows that only give context; ``_is_target`` tells them apart."""
    flagged = target.withColumn(IS_TARGET, F.lit(True))
    if history is None:
        return flagged
    return history.withColumn(IS_TARGET, F.lit(False)).unionByName(flagged)


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    context_length: int = 12,
    *,
    carry_columns: Sequence[str] = (),
    series: Series = Series(),
) -> DataFrame:
    """One row per target with the ``context_length`` rows before it.

    ``context`` is an array (oldest first) of arrays (in the order of ``features``). ``target``
    and every one of ``carry_columns`` come from the target row itself, so an anchor is aligned by
    construction. Rows with a shorter past are left out; history rows are dropped only after the
    window was taken.
    """
    if context_length < 1:
        raise ValueError("A context takes at least one row")
    required = [*series.keys, series.order, label, *features, *carry_columns]
    require_columns(df, required, "sequence columns")
    if IS_TARGET not in df.columns:
        df = with_history(df)
    used = list(dict.fromkeys([*required, IS_TARGET]))
    carried = with_carry(df.select(*used), series, features, context_length)
    windows = carried.withColumn("_past", prior_rows(series, features, context_length))
    # Zero or one array per row: made once, where a filter and the columns after it would each make it anew.
    full = F.filter(F.array("_past"), lambda rows: rows.isNotNull())
    windows = windows.select("*", F.explode(full).alias("_rows")).where(F.col(IS_TARGET))
    context = F.transform(
        "_rows", lambda row: F.array(*[row[name].cast("double") for name in features])
    )
    return drop_helpers(windows).select(
        *series.keys,
        series.order,
        context.alias("context"),
        F.col(label).cast("double").alias("target"),
        *[name for name in carry_columns if name not in (*series.keys, series.order)],
    )


def sequence_targets(
    df: DataFrame, column: str, context_length: int = 12, *, series: Series = Series()
) -> DataFrame:
    """Any column at the target rows: the same rows that :func:`sequence_windows` keeps.

    Only the row's position matters, so no context is collected.
    """
    if context_length < 1:
        raise ValueError("A context takes at least one row")
    if IS_TARGET not in df.columns:
        df = with_history(df)
    placed = with_position(df.select(*series.keys, series.order, column, IS_TARGET), series)
    return placed.where((F.col("_position") >= context_length) & F.col(IS_TARGET)).select(
        *series.keys, series.order, column
    )


def common_rows(df: DataFrame, context_length: int = 12, *, series: Series = Series()) -> DataFrame:
    """Rows that models with a context of this length score too: those with enough rows before them.

    Score baselines on them, of a dataset or a holdout, to compare them with sequence models.
    """
    placed = with_position(df, series).where(F.col("_position") >= context_length)
    return placed.select(*df.columns)


def flatten_lags(windows: DataFrame, output: str = "features") -> DataFrame:
    """Context as one ML vector of context_length x features values, oldest row first."""
    return windows.withColumn(output, array_to_vector(F.flatten("context")))


# --- standardizer ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Standardizer:
    """Fitted means and deviations: as many numbers as features, independent of the data size."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    target_mean: float
    target_std: float

    def without_target_scaling(self) -> Standardizer:
        return Standardizer(self.features, self.means, self.stds, 0.0, 1.0)

    def scale_target(self, target: Column) -> Column:
        return (target - F.lit(self.target_mean)) / F.lit(self.target_std)

    def invert_target(self, scaled: Column) -> Column:
        return scaled * F.lit(self.target_std) + F.lit(self.target_mean)

    def scaled_features(self) -> list[Column]:
        """Each feature column of a row, scaled."""
        parts = zip(self.features, self.means, self.stds)
        return [(F.col(f).cast("double") - F.lit(mean)) / F.lit(std) for f, mean, std in parts]

    def scale_context(self, context: Column) -> Column:
        def scale_row(row: Column) -> Column:
            return F.array(
                *[
                    (row[i] - F.lit(mean)) / F.lit(std)
                    for i, (mean, std) in enumerate(zip(self.means, self.stds))
                ]
            )

        return F.transform(context, scale_row)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Standardizer:
        raw = json.loads(text)
        return Standardizer(
            tuple(raw["features"]),
            tuple(raw["means"]),
            tuple(raw["stds"]),
            raw["target_mean"],
            raw["target_std"],
        )


def _pooled(groups: Column) -> Column:
    """Weighted mean and population deviation from per-group (weight, mean, variance)."""
    zero = F.lit(0.0)
    weight = F.aggregate(groups, zero, lambda acc, g: acc + g["weight"])
    mean = F.aggregate(groups, zero, lambda acc, g: acc + g["weight"] * g["mean"]) / weight
    spread = (
        F.aggregate(
            groups,
            zero,
            lambda acc, g: acc
            + g["weight"] * (g["variance"] + (g["mean"] - mean) * (g["mean"] - mean)),
        )
        / weight
    )
    return F.struct(weight.alias("weight"), mean.alias("mean"), F.sqrt(spread).alias("std"))


def fit_standardizer(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    context_length: int = 12,
    *,
    series: Series = Series(),
) -> DataFrame:
    """(column_name, role, mean, std) over all context windows of ``df``, which are never built.

    A row counts once per window that contains it: that number follows from its position and the
    length of its series, and is ``context_length`` for all rows but those near an end. Rows are
    aggregated per such weight (at most context_length + 1 groups, stable one-pass variance), and
    the groups are pooled. Target statistics run over the rows that are targets.
    """
    depth = F.lit(context_length)
    placed = with_position(df.select(*series.keys, series.order, label, *features), series)
    before = F.col("_position")
    after = F.col("_length") - 1 - before
    weight = F.greatest(
        F.least(after, depth) - F.greatest(depth - before, F.lit(1)) + 1, F.lit(0)
    )
    is_target = before >= depth
    rows = placed.withColumns({"_weight": weight.cast("long"), "_target": is_target})

    names = [f"f{i}" for i in range(len(features))]
    moments = []
    for name, feature in zip(names, features):
        value = F.col(feature).cast("double")
        moments += [F.avg(value).alias(f"{name}_mean"), F.var_pop(value).alias(f"{name}_var")]
    value = F.when(F.col("_target"), F.col(label).cast("double"))
    moments += [
        F.avg(value).alias("y_mean"),
        F.var_pop(value).alias("y_var"),
        F.count(value).cast("double").alias("y_weight"),
    ]
    groups = rows.groupBy("_weight").agg(F.count(F.lit(1)).alias("_n"), *moments)

    weighted = (F.col("_weight") * F.col("_n")).cast("double")
    entries = [
        F.struct(
            F.lit(feature).alias("column_name"),
            F.lit("feature").alias("role"),
            F.lit(i).alias("ordinal"),
            weighted.alias("weight"),
            F.col(f"{name}_mean").alias("mean"),
            F.col(f"{name}_var").alias("variance"),
        )
        for i, (name, feature) in enumerate(zip(names, features))
    ]
    entries.append(
        F.struct(
            F.lit(label).alias("column_name"),
            F.lit("target").alias("role"),
            F.lit(len(features)).alias("ordinal"),
            F.col("y_weight").alias("weight"),
            F.col("y_mean").alias("mean"),
            F.col("y_var").alias("variance"),
        )
    )
    pooled = (
        groups.select(F.inline(F.array(*entries)))
        .where(F.col("weight") > 0)
        .groupBy("ordinal", "column_name", "role")
        .agg(_pooled(F.collect_list(F.struct("weight", "mean", "variance"))).alias("_s"))
    )
    std = F.when(F.col("_s.std") < MIN_STD, F.lit(1.0)).otherwise(F.col("_s.std"))
    return pooled.select(
        "ordinal", "column_name", "role", F.col("_s.mean").alias("mean"), std.alias("std")
    )


def load_standardizer(stats: DataFrame) -> Standardizer:
    """Fetch the fitted numbers: one row per feature and one for the target."""
    rows = sorted(stats.collect(), key=lambda r: r["ordinal"])
    if not rows:
        raise ValueError("No series is longer than the context, so there is nothing to fit")
    features = [r for r in rows if r["role"] == "feature"]
    target = next(r for r in rows if r["role"] == "target")
    return Standardizer(
        tuple(r["column_name"] for r in features),
        tuple(r["mean"] for r in features),
        tuple(r["std"] for r in features),
        target["mean"],
        target["std"],
    )


def apply_standardizer(windows: DataFrame, standardizer: Standardizer) -> DataFrame:
    return windows.withColumns(
        {
            "context": standardizer.scale_context(F.col("context")),
            "target": standardizer.scale_target(F.col("target")),
        }
    )


def invert_targets(
    df: DataFrame, standardizer: Standardizer, column: str, output: str | None = None
) -> DataFrame:
    return df.withColumn(output or column, standardizer.invert_target(F.col(column)))
