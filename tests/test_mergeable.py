"""Rollups from stored parts: equal to those from usage."""

import pytest
from pyspark.sql import functions as F

from gridlapse.operators import mergeable, rollup
from gridlapse.schema import WINDOW_US
from tests import frames


def placed(spark, n=400):
    rows = [
        {"start_time": (k * 7919 % 90 - 30) * WINDOW_US // 3, "collection_id": None if k % 41 == 0 else 10**15 + k % 37, "machine_id": k % 11, "cpu": float(k % 5)}
        for k in range(n)
    ]
    usage = frames.usage(spark, rows)
    return usage.withColumns({"cell": F.when(F.col("machine_id") < 6, "e").otherwise("f"), "pdu": F.lit("pdu1")})


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("times", [1, 3, 12])
def test_longer_windows_equal_those_of_the_usage(spark, tmp_path, times):
    usage = placed(spark)
    parts = mergeable.usage_parts(usage.repartition(5))
    parts.write(str(tmp_path / "parts"))
    stored = mergeable.UsageParts.read(spark, str(tmp_path / "parts"))
    merged = mergeable.rollup_of_parts(mergeable.merge_parts(stored, times * WINDOW_US))
    direct = rollup.usage_rollup(usage, width_us=times * WINDOW_US)
    assert rows_of(merged) == rows_of(direct) and merged.columns == direct.columns


def test_numbers_have_no_gaps(spark):
    ids = spark.range(0, 10_000, 7).select((F.col("id") * 10**12).alias("x")).unionByName(spark.createDataFrame([(None,), (0,)], "x long"))
    numbers = [r.number for r in mergeable.number_ids(ids.repartition(6), "x").collect()]
    assert sorted(numbers) == list(range(1, 1430))


def test_members_beyond_one_bitmap(spark):
    usage = frames.usage(spark, [{"start_time": 0, "collection_id": 1, "machine_id": 1, "cpu": 1.0}])
    many = usage.crossJoin(spark.range(70_000).select("id")).withColumn("collection_id", F.col("id") * 3).drop("id")
    many = many.withColumns({"cell": F.lit("e"), "pdu": F.lit("p")})
    parts = mergeable.usage_parts(many)
    row = mergeable.rollup_of_parts(parts).first()
    assert (row["collection_count"], row["machine_count"], row["instance_count"]) == (70_000, 1, 70_000)
    assert parts.members.where("member = 'collection_id'").count() == 3


def test_exports_with_shared_numbers_unite(spark):
    usage = placed(spark)
    numbers = {c: mergeable.number_ids(usage, c) for c in mergeable.MEMBERS}
    one, other = (mergeable.usage_parts(usage.where(f"machine_id % 2 = {k}"), numbers=numbers) for k in (0, 1))
    both = mergeable.rollup_of_parts(mergeable.union_parts(one, other))
    assert rows_of(both) == rows_of(rollup.usage_rollup(usage))
    with pytest.raises(ValueError, match="multiple"):
        mergeable.merge_parts(one, WINDOW_US * 3 // 2)
    with pytest.raises(ValueError, match="different widths"):
        mergeable.union_parts(one, mergeable.merge_parts(other, 2 * WINDOW_US))


def test_no_usage(spark):
    assert mergeable.rollup_of_parts(mergeable.usage_parts(placed(spark).where("machine_id < 0"))).count() == 0


def test_few_members_of_many_buckets_stay_small(spark, tmp_path):
    """A window that touches 200 buckets with one member each stores 200 words, not 200 bitmaps."""
    ids = spark.range(200 * 32_768).select(F.col("id").alias("collection_id"), (F.col("id") + 1).alias("number"))
    machines = spark.createDataFrame([(1, 1)], "machine_id long, number long")
    usage = frames.usage(spark, [{"start_time": 0, "collection_id": 1, "machine_id": 1, "cpu": 1.0}])
    thin = usage.crossJoin(spark.range(200).select("id")).withColumn("collection_id", F.col("id") * 32_768 + F.col("id") * 163).drop("id")
    thin = thin.withColumns({"cell": F.lit("e"), "pdu": F.lit("p")})
    parts = mergeable.usage_parts(thin, numbers={"collection_id": ids, "machine_id": machines})
    parts = mergeable.union_parts(parts, parts)
    row = mergeable.rollup_of_parts(parts).first()
    assert (row["collection_count"], row["machine_count"]) == (200, 1)
    assert parts.members.select(F.sum(F.length(F.to_json("words")))).first()[0] < 201 * 60
