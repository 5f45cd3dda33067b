"""Data checks: value ranges, join coverage, candidate ranking and missing rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlapse.functions.buckets import in_window_range, window_index
from gridlapse.functions.expressions import good_power, usage_filter
from gridlapse.operators.rollup import EXACT_KEYS, WINDOW_KEYS
from gridlapse.schema import ID_COLUMNS, WINDOW_US


def power_range(power: DataFrame) -> DataFrame:
    limits = []
    for name in ("time", "measured_power_util", "production_power_util"):
        limits += [F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}")]
    return power.agg(F.count(F.lit(1)).alias("row_count"), *limits)


def usage_windows(
    placed_usage: DataFrame,
    *,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
    exclude_alloc: bool = False,
    min_duration_us: int | None = None,
) -> DataFrame:
    """Distinct (cell, pdu, window) in which any usage started."""
    return (
        placed_usage.where(usage_filter(exclude_alloc, min_duration_us))
        .where(in_window_range("start_time", low, high, width_us))
        .select("cell", "pdu", window_index("start_time", width_us).alias("window_index"))
        .distinct()
    )


def usage_start_times(
    placed_usage: DataFrame, *, exclude_alloc: bool = True, min_duration_us: int | None = WINDOW_US
) -> DataFrame:
    """Distinct (cell, pdu, start time), the unbucketed form."""
    return (
        placed_usage.where(usage_filter(exclude_alloc, min_duration_us))
        .select("cell", "pdu", F.col("start_time").alias("window_start"))
        .distinct()
    )


def power_windows(
    power: DataFrame, *, low: int | None = None, high: int | None = None, width_us: int = WINDOW_US
) -> DataFrame:
    return (
        power.where(good_power())
        .where(in_window_range("time", low, high, width_us))
        .select("cell", "pdu", window_index("time", width_us).alias("window_index"))
        .distinct()
    )


def coverage_join(
    windows: DataFrame, used: DataFrame, keys: Sequence[str] = tuple(WINDOW_KEYS)
) -> DataFrame:
    """Power windows with a flag telling whether any usage falls into them."""
    marked = used.select(*keys, F.lit(True).alias("matched"))
    return windows.join(marked, list(keys), "left").withColumn(
        "matched", F.coalesce(F.col("matched"), F.lit(False))
    )


def _matched_ratio() -> Column:
    return F.try_divide(F.count_if("matched"), F.count(F.lit(1)))


def join_coverage(power: DataFrame, start_times: DataFrame) -> DataFrame:
    """Global coverage of raw power readings by raw usage start times."""
    readings = power.select("cell", "pdu", F.col("time").alias("window_start"))
    return coverage_join(readings, start_times, EXACT_KEYS).agg(
        F.count(F.lit(1)).alias("total_power_windows"),
        F.count_if("matched").alias("matched_windows"),
        F.count_if(~F.col("matched")).alias("unmatched_windows"),
        _matched_ratio().alias("matched_ratio"),
    )


def _coverage_by_pdu(windows: DataFrame, used: DataFrame) -> DataFrame:
    return (
        coverage_join(windows, used)
        .groupBy("cell", "pdu")
        .agg(
            F.count(F.lit(1)).alias("power_windows"),
            F.count_if("matched").alias("matched_usage_windows"),
            F.count_if(~F.col("matched")).alias("unmatched_usage_windows"),
            _matched_ratio().alias("matched_ratio"),
        )
    )


def join_coverage_by_pdu(windows: DataFrame, used: DataFrame) -> DataFrame:
    return _coverage_by_pdu(windows, used).orderBy("cell", "pdu")


@dataclass(frozen=True)
class Tier:
    label: str
    min_ratio: float
    min_windows: int


# Fixed values of the published ranking.
TIERS = (
    Tier("strong_dev_candidate", 0.98, 300),
    Tier("usable_dev_candidate", 0.95, 200),
    Tier("holdout_or_backup_candidate", 0.90, 150),
)
NO_TIER = "drop_for_now"


def tier(
    ratio: str | Column = "matched_ratio",
    windows: str | Column = "matched_usage_windows",
    tiers: Sequence[Tier] = TIERS,
) -> Column:
    """First tier whose two thresholds are both met."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    windows = F.col(windows) if isinstance(windows, str) else windows
    choices = [
        F.when((ratio >= F.lit(t.min_ratio)) & (windows >= F.lit(t.min_windows)), F.lit(t.label))
        for t in tiers
    ]
    return F.coalesce(*choices, F.lit(NO_TIER))


def rank_pdu_candidates(
    windows: DataFrame, used: DataFrame, tiers: Sequence[Tier] = TIERS
) -> DataFrame:
    return (
        _coverage_by_pdu(windows, used)
        .withColumn("recommendation", tier(tiers=tiers))
        .orderBy(
            F.col("matched_ratio").desc_nulls_last(),
            F.col("matched_usage_windows").desc(),
            "cell",
            "pdu",
        )
    )


# --- quality ---------------------------------------------------------------------------------


def _missing(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def quality_summary(df: DataFrame, label: str = "measured_power_util") -> DataFrame:
    """One row: counts, duplicate keys, label range, NULL keys.

    Duplicates are rows minus distinct keys; the key is one struct so that NULL keys count too.
    """
    known_label = F.when(~_missing(df.schema[label]), F.col(label))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct(*ID_COLUMNS))).alias("duplicate_rows"),
        F.min(known_label).alias("min_label"),
        F.max(known_label).alias("max_label"),
        F.count_if(F.col("cell").isNull()).alias("null_cells"),
        F.count_if(F.col("pdu").isNull()).alias("null_pdus"),
        F.count_if(F.col("window_start").isNull()).alias("null_windows"),
    )


def missing_rates(df: DataFrame) -> DataFrame:
    """(column_name, missing_rate) for every column, from one pass over the data."""
    rates = df.agg(
        *[F.avg(_missing(f).cast("double")).alias(f"_rate_{i}") for i, f in enumerate(df.schema.fields)]
    )
    pairs = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"_rate_{i}").alias("missing_rate"))
        for i, name in enumerate(df.columns)
    ]
    return rates.select(F.inline(F.array(*pairs)))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))
