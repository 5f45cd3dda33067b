"""Window arithmetic on microsecond times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlapse.schema import WINDOW_US


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def window_index(time_us: str | Column, width_us: int = WINDOW_US) -> Column:
    """Bucket number: floor of a floating-point division, so -1 falls into bucket -1."""
    return F.floor(_col(time_us) / F.lit(float(width_us))).cast("long")


def window_start(index: str | Column, width_us: int = WINDOW_US) -> Column:
    return F.timestamp_micros(_col(index) * F.lit(width_us).cast("long"))


def micros(timestamp: str | Column) -> Column:
    return F.unix_micros(_col(timestamp))


def in_window_range(
    time_us: str | Column, low: int | None, high: int | None, width_us: int = WINDOW_US
) -> Column:
    """Inclusive range on the bucket number.

    A predicate on ``floor(time / width)`` is opaque to Parquet, so the same range is stated on the
    raw time as well: that half is pushed to the scan and skips row groups. It is one bucket wider
    on each side, which leaves the decision at the edges to the bucket number itself.
    """
    time_us = _col(time_us)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (time_us >= F.lit((low - 1) * width_us))
        keep = keep & (window_index(time_us, width_us) >= F.lit(low))
    if high is not None:
        keep = keep & (time_us < F.lit((high + 2) * width_us))
        keep = keep & (window_index(time_us, width_us) <= F.lit(high))
    return keep


def parse_utc(text: Column) -> Column:
    """Timestamp from text; without a zone it is read as UTC. What does not parse is NULL."""
    trimmed = F.regexp_replace(F.trim(text), r"\s*UTC$", "Z")
    zoned = F.when(trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), trimmed).otherwise(
        F.concat(trimmed, F.lit("Z"))
    )
    return zoned.try_cast("timestamp")


def with_utc_time(df: DataFrame, column: str = "window_start") -> DataFrame:
    """Make ``column`` a timestamp: text and zoneless times are UTC, whatever the session zone."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.TimestampNTZType)):
        return df.withColumn(column, parse_utc(F.col(column).cast("string")))
    return df
