"""Usage rollups that merge: hour and day windows from stored five-minute parts, distinct counts exact.

A distinct count cannot be added up. So each window keeps the set of its members: ids are numbered from 1 without gaps, a
window has a row for each bucket of 32,768 numbers that it touches, and the row has those words of 64 bits in which a bit is
set. The set of a longer window is the union of its parts' words, bucket by bucket, and its count is the sum of the bits.
Usage is read once. A full bucket has 512 words, one with a single member has one: what is stored and merged is never more
than a word for each member, and aggregates hold numbers of fixed size only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlapse.functions.buckets import window_index
from gridlapse.functions.expressions import usage_filter
from gridlapse.operators.rollup import WINDOW_KEYS
from gridlapse.plans.stage import stage
from gridlapse.schema import WINDOW_US

#: What windows count different values of, and the measure that counts them.
MEMBERS = {"collection_id": "collection_count", "machine_id": "machine_count"}
#: Lower bits of ``monotonically_increasing_id``: a row's place in its partition.
PLACE_BITS = 33
#: A word has 2**6 numbers, a bucket 2**9 words.
WORD_PLACE_BITS = 6
BUCKET_PLACE_BITS = 9


def number_ids(df: DataFrame, column: str) -> DataFrame:
    """``column`` and ``number``: every value but NULL, numbered from 1 without gaps.

    Values are numbered within their partitions, and partitions start where the one before ends: no sort, and one row
    per partition is all that meets.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    placed = stage(values.withColumn("_id", F.monotonically_increasing_id()), "placed-ids")
    part = F.shiftright("_id", PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_of", part).join(stage(starts, "id-starts"), F.col("_of") == F.col("_part"))
    return numbered.select(column, (F.col("_start") + F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1) + 1).alias("number"))


def _buckets(words: DataFrame) -> DataFrame:
    """A row per window, member and bucket from rows of single words, which may come several times."""
    keys = [*WINDOW_KEYS, "member", "bucket"]
    united = words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    return united.groupBy(*keys).agg(F.collect_list(F.struct("word", "bits")).alias("words"))


@dataclass(frozen=True)
class UsageParts:
    """Parts of windows of one width: sums, and members as words of bits."""

    width_us: int
    sums: DataFrame
    members: DataFrame

    def write(self, path: str) -> None:
        self.sums.write.parquet(f"{path}/sums")
        self.members.write.parquet(f"{path}/members")

    @staticmethod
    def read(spark: SparkSession, path: str, width_us: int = WINDOW_US) -> UsageParts:
        return UsageParts(width_us, spark.read.parquet(f"{path}/sums"), spark.read.parquet(f"{path}/members"))


def usage_parts(
    placed_usage: DataFrame,
    *,
    width_us: int = WINDOW_US,
    exclude_alloc: bool = False,
    min_duration_us: int | None = None,
    numbers: dict[str, DataFrame] | None = None,
) -> UsageParts:
    """Mergeable parts per (cell, pdu, window).

    ``numbers`` are the ids' numbers, as of :func:`number_ids`; parts merge with others made with the same ones.
    """
    rows = placed_usage.where(usage_filter(exclude_alloc, min_duration_us)).select(
        "cell",
        "pdu",
        window_index("start_time", width_us).alias("window_index"),
        *MEMBERS,
        F.col("average_usage.cpus").alias("_cpu"),
    )
    sums = rows.groupBy(*WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("instance_count"),
        F.sum("_cpu").alias("total_cpu_usage"),
        F.count("_cpu").alias("cpu_rows"),
        F.max("_cpu").alias("max_cpu_usage"),
    )
    members = None
    for column in MEMBERS:
        known = (numbers or {}).get(column)
        known = number_ids(rows, column) if known is None else known
        seen = rows.where(F.col(column).isNotNull()).select(*WINDOW_KEYS, column).distinct()
        numbered = seen.join(known.withColumnRenamed(column, "_value"), F.col(column) == F.col("_value"))
        place = F.col("number") - 1
        words = numbered.select(
            *WINDOW_KEYS,
            F.lit(column).alias("member"),
            F.shiftright(place, WORD_PLACE_BITS + BUCKET_PLACE_BITS).alias("bucket"),
            F.shiftright(place, WORD_PLACE_BITS).bitwiseAND((1 << BUCKET_PLACE_BITS) - 1).cast("int").alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND((1 << WORD_PLACE_BITS) - 1).cast("int")).alias("bits"),
        )
        members = words if members is None else members.unionByName(words)
    return UsageParts(width_us, sums, _buckets(members))


def merge_parts(parts: UsageParts, width_us: int) -> UsageParts:
    """Parts of longer windows, each of a whole number of the given ones."""
    if width_us % parts.width_us:
        raise ValueError("The width must be a multiple of the parts'")
    index = F.floor(F.col("window_index") / F.lit(float(width_us // parts.width_us))).cast("long").alias("window_index")
    sums = parts.sums.withColumn("window_index", index).groupBy(*WINDOW_KEYS).agg(
        F.sum("instance_count").alias("instance_count"),
        F.sum("total_cpu_usage").alias("total_cpu_usage"),
        F.sum("cpu_rows").alias("cpu_rows"),
        F.max("max_cpu_usage").alias("max_cpu_usage"),
    )
    keys = [*WINDOW_KEYS, "member", "bucket"]
    # Packed rows meet before they are unfolded: both aggregates then need no further shuffle.
    members = parts.members.withColumn("window_index", index).repartition(*keys)
    return UsageParts(width_us, sums, _buckets(members.select(*keys, F.inline("words"))))


def union_parts(one: UsageParts, other: UsageParts) -> UsageParts:
    """Both tables' parts, as of an old and a new export with the same id numbers; windows may be in both."""
    if one.width_us != other.width_us:
        raise ValueError("Parts of different widths")
    both = UsageParts(one.width_us, one.sums.unionByName(other.sums), one.members.unionByName(other.members))
    return merge_parts(both, one.width_us)


def rollup_of_parts(parts: UsageParts) -> DataFrame:
    """The measures of :func:`gridlapse.operators.rollup.usage_rollup`, without the usage."""
    set_bits = F.aggregate("words", F.lit(0), lambda n, word: n + F.bit_count(word["bits"]))
    sizes = parts.members.select(*WINDOW_KEYS, "member", set_bits.cast("long").alias("_n"))
    counts = sizes.groupBy(*WINDOW_KEYS).agg(
        *[F.sum(F.when(F.col("member") == column, F.col("_n"))).alias(name) for column, name in MEMBERS.items()]
    )
    joined = parts.sums.join(counts, WINDOW_KEYS, "left")
    return joined.select(
        *WINDOW_KEYS,
        "instance_count",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in MEMBERS.values()],
        "total_cpu_usage",
        (F.col("total_cpu_usage") / F.nullif(F.col("cpu_rows"), F.lit(0))).alias("avg_cpu_usage"),
        "max_cpu_usage",
    )
