"""Least squares on the rows before a row, without building their windows.

A window of L rows and F columns is a vector of L * F numbers, and its normal equations need the sum
of that vector's products with itself. Neighbouring windows share all rows but one, so those sums follow from
lagged cross products: the sum for the window's first row and its row j is one product of two shifted
matrices, and the sum for rows i + 1 and j + 1 is that for rows i and j, plus the pair of rows that enters at
the end and minus the one that leaves at the start. That is L products of F x F instead of one of (L * F)**2 per
row. It is done per block of a series, with the rows before the block as its *carry*, and blocks add up.

Scoring needs no windows either: each row is weighted once for every lag, and a prediction adds up one such number of
each of the rows before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.plans.blocks import CARRY, ROW, Series, drop_helpers, earlier_row, with_carry
from gridlapse.plans.stage import stage

#: Block sums that one task adds up at a time.
FAN_IN = 64


def block_sums(rows: np.ndarray, target: np.ndarray, carry: np.ndarray, depth: int) -> tuple[int, np.ndarray] | None:
    """Number of a block's windows, and the sum of products of (window, 1, target) with itself.

    ``carry`` holds the last rows before the block, at most ``depth``.
    """
    every = np.concatenate((carry, rows))
    start, stop = max(depth, len(carry)), len(every)
    if stop <= start:
        return None
    width = rows.shape[1]
    size = depth * width
    known = target[start - len(carry) :]
    shifted = [every[start - depth + i : stop - depth + i] for i in range(depth)]
    sums = np.zeros((size + 2, size + 2))
    cells = sums[:size, :size].reshape(depth, width, depth, width)  # a view
    for j in range(depth):
        cells[0, :, j] = shifted[0].T @ shifted[j]
    for i in range(1, depth):
        for j in range(i, depth):
            enters = np.outer(every[stop - depth + i - 1], every[stop - depth + j - 1])
            leaves = np.outer(every[start - depth + i - 1], every[start - depth + j - 1])
            cells[i, :, j] = cells[i - 1, :, j - 1] + enters - leaves
    for i, part in enumerate(shifted):
        sums[i * width : (i + 1) * width, size] = part.sum(axis=0)
        sums[i * width : (i + 1) * width, size + 1] = part.T @ known
    sums[size, size], sums[size, size + 1], sums[size + 1, size + 1] = len(known), known.sum(), known @ known
    return len(known), np.triu(sums)


def _carried(value: pa.Scalar, features: Sequence[str]) -> np.ndarray:
    rows = value.as_py() or []
    return np.array([[row[f] for f in features] for row in rows], dtype=np.float64).reshape(-1, len(features))


def lagged_sums(df: DataFrame, features: Sequence[str], target: str, depth: int, series: Series = Series()) -> np.ndarray:
    """The sum over all windows, as a symmetric matrix; a missing number makes it one without finite values.

    Windows are those of :func:`gridlapse.operators.sequence.sequence_windows`. Blocks are summed by tasks, ``FAN_IN`` at a time, until one is left.
    """
    numbers = df.select(*series.keys, series.order, *[F.col(f).cast("double").alias(f) for f in (*features, target)])
    carried = with_carry(numbers.where(series.named()), series, features, depth)
    schema = "sums array<double>"

    def of_block(block: pa.Table) -> pa.Table:
        block = block.sort_by(ROW)
        rows = np.column_stack([block[f].to_numpy() for f in features])
        found = block_sums(rows, block[target].to_numpy(), _carried(block[CARRY][0], features), depth)
        return pa.table({"sums": pa.array([] if found is None else [found[1].ravel()], pa.list_(pa.float64()))})

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(len(group["sums"][0]))
        for chunk in group["sums"].chunks:
            total += chunk.values.to_numpy()[chunk.offsets[0].as_py() :].reshape(len(chunk), -1).sum(axis=0)
        return pa.table({"sums": pa.array([total], pa.list_(pa.float64()))})

    sums = stage(carried.groupBy(*series.block_keys()).applyInArrow(of_block, schema), "lagged-sums")
    left = sums.count()
    while left > 1:
        parts = ceil(left / FAN_IN)
        dealt = sums.withColumn("part", F.pmod(F.xxhash64("sums"), F.lit(parts)))
        sums = stage(dealt.groupBy("part").applyInArrow(added, schema), "lagged-sums")
        left = sums.count() if parts > 1 else 1
    row = sums.first()
    size = depth * len(features) + 2
    whole = np.zeros((size, size)) if row is None else np.array(row["sums"]).reshape(size, size)
    return whole + np.triu(whole, 1).T


@dataclass(frozen=True)
class LagModel:
    """``weights`` has a row of numbers per lag, the oldest first, and a number per column."""

    bias: float
    weights: tuple[tuple[float, ...], ...]

    @property
    def depth(self) -> int:
        return len(self.weights)

    def of_vector(self, column: str) -> Column:
        """Prediction from a flattened window."""
        weights = F.array(*[F.lit(w) for row in self.weights for w in row])
        products = F.zip_with(vector_to_array(column), weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(self.bias), lambda total, x: total + x)

    def score(self, df: DataFrame, inputs: Sequence[Column], series: Series = Series(), output: str = "prediction") -> DataFrame:
        """``df`` with a prediction for each row that has enough rows before it; other rows are left out.

        ``inputs`` are the columns the weights belong to, as expressions.
        """
        names = [f"_lag_{k}" for k in range(1, self.depth + 1)]
        weighted = {}
        for name, weights in zip(names, reversed(self.weights)):
            total = F.lit(0.0)
            for column, weight in zip(inputs, weights):
                total = total + column * F.lit(weight)
            weighted[name] = total
        carried = with_carry(df.withColumns(weighted), series, names, self.depth)
        parts = {f"{name}_then": earlier_row(series, name, k) for k, name in enumerate(names, 1)}
        before = F.col(ROW) - 1 + F.when(F.col(CARRY).isNull(), 0).otherwise(F.size(CARRY))
        scored = carried.withColumns(parts).where(series.named() & (before >= self.depth))
        total = F.lit(self.bias)
        for name in parts:
            total = total + F.col(name)
        return drop_helpers(scored.withColumn(output, total)).drop(*names, *parts)


def solve(sums: np.ndarray, width: int, penalty: float) -> LagModel:
    """Ridge regression of the target on standardized columns; constant columns get no weight.

    The penalty is divided by the target's deviation. That of a constant target has no weights at all.
    """
    if not np.isfinite(sums).all():
        raise ValueError("A feature or the target is missing or not a number")
    size = len(sums) - 2
    n = sums[size, size]
    if not n:
        raise ValueError("No series is longer than the context, so there is nothing to fit")
    mean = np.append(sums[:size, size], sums[size, size + 1]) / n  # of the columns and the target
    inner = np.append(np.arange(size), size + 1)
    spread = sums[np.ix_(inner, inner)] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(spread), 0))
    weights = np.zeros(size)
    moves = std[:size] > 1e-12
    if std[size] > 0 and moves.any():
        scale = std[:size][moves]
        matrix = spread[:size, :size][np.ix_(moves, moves)] / np.outer(scale, scale)
        known = spread[:size, size][moves] / (scale * std[size])
        matrix[np.diag_indices_from(matrix)] += penalty / std[size]
        weights[moves] = np.linalg.lstsq(matrix, known, rcond=None)[0] * std[size] / scale
    bias = float(mean[size] - weights @ mean[:size])
    return LagModel(bias, tuple(tuple(map(float, row)) for row in weights.reshape(-1, width)))


def fit_lagged(
    df: DataFrame, features: Sequence[str], target: str, depth: int, *, penalty: float = 1e-6, series: Series = Series()
) -> LagModel:
    """Least squares of ``target`` on the ``depth`` rows before it, from one pass over the rows."""
    return solve(lagged_sums(df, features, target, depth, series), len(features), penalty)
