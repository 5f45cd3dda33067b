"""Row-based windows over series of any length.

``lag`` or "the L rows before this one" partitioned by series puts a whole series into one task.
Here a series is cut into blocks of time, windows run per block, and every block gets the last
``depth`` rows before it as an array (its *carry*). The result is the same as over the uncut
series: position is by row, so gaps in time, also whole missing blocks, change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gridlapse.functions.buckets import micros
from gridlapse.schema import SERIES_KEYS, WINDOW_US

BLOCK_WINDOWS = 4096
LAST_BLOCK = 2**62

BLOCK = "_block"
CARRY = "_carry"
ROW = "_block_row"


@dataclass(frozen=True)
class Series:
    """How a frame is read as a set of time series."""

    keys: tuple[str, ...] = SERIES_KEYS
    order: str = "window_start"
    block_us: int = BLOCK_WINDOWS * WINDOW_US

    def block_of(self) -> Column:
        """Block number; a row without a time belongs at the end of its series."""
        block = F.floor(micros(self.order) / F.lit(float(self.block_us))).cast("long")
        return F.coalesce(block, F.lit(LAST_BLOCK))

    def by_block(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(F.col(self.order).asc_nulls_last())

    def along(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(
            F.col(BLOCK).asc(), F.col(self.order).asc_nulls_last()
        )

    def block_keys(self) -> list[str]:
        return [*self.keys, BLOCK]

    def named(self) -> Column:
        """Rows that belong to a series at all: every key is known."""
        known = F.lit(True)
        for key in self.keys:
            known = known & F.col(key).isNotNull()
        return known


def _numbered(df: DataFrame, series: Series) -> DataFrame:
    """Add block and row number in the block. This is the one shuffle of the rows themselves."""
    blocked = df.withColumn(BLOCK, series.block_of())
    return blocked.withColumn(ROW, F.row_number().over(series.by_block()))


def _join_side(df: DataFrame, side: DataFrame, series: Series, first_rows: int | None) -> DataFrame:
    """Left join with a table of one row per block, on the partitioning the rows already have.

    Plain equality keeps that partitioning usable; ``first_rows`` limits the match to the first
    rows of each block, so that wide side columns are not repeated on every row.
    """
    keys = series.block_keys()
    added = [name for name in side.columns if name not in keys]
    renamed = side.select(*[F.col(k).alias(f"_side_{k}") for k in keys], *added)
    condition = F.lit(True) if first_rows is None else df[ROW] <= F.lit(first_rows)
    for k in keys:
        condition = condition & (df[k] == renamed[f"_side_{k}"])
    return df.join(renamed, condition, "left").select(*df.columns, *added)


def _last_row(df: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Latest row of each block by a hash aggregate, combined map-side without sorting."""
    newest = [F.max_by(c, series.order).alias(c) for c in columns if c != series.order]
    return (
        df.withColumn(BLOCK, series.block_of())
        .groupBy(*series.block_keys())
        .agg(F.max(series.order).alias(series.order), *newest)
    )


def _last_rows(df: DataFrame, series: Series, columns: Sequence[str], depth: int) -> DataFrame:
    """Latest ``depth`` rows of each block; Spark cuts the blocks to them before the shuffle."""
    newest_first = Window.partitionBy(*series.block_keys()).orderBy(
        F.col(series.order).desc_nulls_first()
    )
    wanted = list(dict.fromkeys([*series.keys, BLOCK, series.order, *columns]))
    return (
        df.withColumn(BLOCK, series.block_of())
        .select(*wanted)
        .withColumn("_from_end", F.row_number().over(newest_first))
        .where(F.col("_from_end") <= depth)
        .drop("_from_end")
    )


def with_carry(df: DataFrame, series: Series, columns: Sequence[str], depth: int) -> DataFrame:
    """Add ``_block``, ``_block_row`` and ``_carry`` (array of structs, oldest row first).

    Only the first ``depth`` rows of a block get a carry; later rows have enough rows before them
    inside the block. The carry is found among the last ``depth`` rows of each block, so what is
    ordered per series is small.
    """
    tails = _last_row(df, series, columns) if depth == 1 else _last_rows(df, series, columns, depth)
    along = series.along()
    earlier = F.collect_list(F.struct(*[F.col(c) for c in columns]))
    carry = (
        tails.withColumn(CARRY, earlier.over(along.rowsBetween(-depth, -1)))
        .withColumn("_previous_block", F.lag(BLOCK).over(along))
        .where(F.col("_previous_block") != F.col(BLOCK))
        .select(*series.block_keys(), CARRY)
    )
    return _join_side(_numbered(df, series), carry, series, depth)


def lag_over_blocks(series: Series, column: str) -> Column:
    """Previous row's value; expects a frame from :func:`with_carry`.

    Rows without a complete series key have no previous row.
    """
    carried = F.try_element_at(F.col(CARRY), F.lit(-1))[column]
    inside = F.lag(column).over(series.by_block())
    return F.when(series.named(), F.when(F.col(ROW) == 1, carried).otherwise(inside))


def earlier_row(series: Series, column: str, steps: int) -> Column:
    """Value ``steps`` rows before, NULL where the series has fewer; expects a frame from :func:`with_carry`."""
    carried = F.try_element_at(F.col(CARRY), (F.col(ROW) - 1 - F.lit(steps)).cast("int"))[column]
    return F.when(F.col(ROW) > steps, F.lag(column, steps).over(series.by_block())).otherwise(carried)


def prior_rows(series: Series, columns: Sequence[str], depth: int) -> Column:
    """Array of the ``depth`` rows before this one, NULL where the series has fewer."""
    frame = series.by_block().rowsBetween(-depth, -1)
    inside = F.collect_list(F.struct(*[F.col(c) for c in columns])).over(frame)
    whole = F.when(F.col(CARRY).isNull(), inside).otherwise(F.concat(F.col(CARRY), inside))
    recent = F.when(F.col(ROW) > depth, inside).otherwise(F.slice(whole, -depth, depth))
    return F.when(series.named() & (F.size(recent) == depth), recent)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK, CARRY, ROW)


def with_position(df: DataFrame, series: Series) -> DataFrame:
    """Add ``_position`` (0-based row number in the series) and ``_length`` (rows in the series).

    Rows without a complete key are left out. Per-block row counts are summed along the series
    first, which is one row per block.
    """
    named = df.where(series.named())
    blocked = named.withColumn(BLOCK, series.block_of())
    counts = blocked.groupBy(*series.block_keys()).agg(F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy(*series.keys).orderBy(BLOCK)
    offsets = counts.select(
        *series.block_keys(),
        F.coalesce(
            F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*series.keys)).alias("_length"),
    )
    joined = _join_side(_numbered(named, series), offsets, series, None)
    return joined.withColumn("_position", F.col("_before") + F.col(ROW) - 1).drop(
        BLOCK, ROW, "_before"
    )
