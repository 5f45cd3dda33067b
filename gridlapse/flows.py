"""The three flows users run end to end, as chains of the operators.

Each step that more than one later job reads is staged once (see :mod:`gridlapse.plans.stage`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridlapse.operators.features import SplitRatios, build_features, chronological_split
from gridlapse.operators.flex import flexibility_table, join_flex_features
from gridlapse.operators.rollup import pdu_training_table
from gridlapse.plans.blocks import BLOCK_WINDOWS, Series
from gridlapse.plans.stage import stage
from gridlapse.schema import WINDOW_US


def feature_table(
    power: DataFrame,
    usage: DataFrame,
    machines: DataFrame,
    *,
    label: str = "measured_power_util",
    series: Series | None = None,
    **scope,
) -> DataFrame:
    """Raw tables to the 25-column feature table of a scope (see ``pdu_training_table``).

    By default a block of a series holds the same number of windows whatever their width.
    """
    if series is None:
        series = Series(block_us=BLOCK_WINDOWS * scope.get("width_us", WINDOW_US))
    table = stage(pdu_training_table(power, usage, machines, **scope), "training-table")
    return stage(build_features(table, label, series), "features")


def training_dataset(
    power: DataFrame,
    usage: DataFrame,
    machines: DataFrame,
    *,
    label: str = "measured_power_util",
    ratios: SplitRatios = SplitRatios(),
    series: Series | None = None,
    **scope,
) -> DataFrame:
    """Feature table with a chronological train / val / test tag."""
    return chronological_split(
        feature_table(power, usage, machines, label=label, series=series, **scope), ratios
    )


def flex_training_dataset(
    power: DataFrame,
    usage: DataFrame,
    machines: DataFrame,
    collection_events: DataFrame,
    instance_events: DataFrame,
    *,
    cell: str | None = None,
    pdus: Sequence[str] | None = None,
    low: int | None = None,
    high: int | None = None,
    width_us: int = WINDOW_US,
    rho: float = 1.5,
    max_class: int = 1,
    require_batch_scheduler: bool = True,
    check: bool = True,
    **training,
) -> DataFrame:
    """Training dataset with the flexibility features of the same scope joined in."""
    scope = {"cell": cell, "pdus": pdus, "low": low, "high": high, "width_us": width_us}
    dataset = training_dataset(power, usage, machines, **scope, **training)
    windows = flexibility_table(
        usage,
        machines,
        collection_events,
        instance_events,
        power,
        rho=rho,
        max_class=max_class,
        require_batch_scheduler=require_batch_scheduler,
        **scope,
    )
    return join_flex_features(dataset, windows, check=check)
