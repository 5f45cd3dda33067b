import pytest
from pyspark.sql import functions as F

from gridlapse.operators import lifecycle
from gridlapse.plans.skew import HOT_SHARE, hot_keys, key_counts, lookup_join, nested_lookup_join
from tests import frames
from tests.frames import W


def facts(spark, rows=9000):
    """A third of the rows are copies of one row, spread over the input; some keys are NULL."""
    ids = spark.range(0, rows, 1, 48)
    key = (
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 400)
        .cast("long")
    )
    value = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    return ids.select(key.alias("k"), value.alias("v"))


def lookup(spark):
    return spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 10).alias("name"))


@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(spark, null_safe):
    left, right = facts(spark), lookup(spark)
    if null_safe:
        right = right.unionByName(spark.createDataFrame([(None, -1)], "k long, name long"))
    salted = lookup_join(left, right, ["k"], null_safe=null_safe, hot_share=0.01, min_hot_rows=10)
    plain = lookup_join(left, right, ["k"], null_safe=null_safe, hot_share=None)
    assert salted.columns == ["k", "v", "name"]
    assert salted.count() == left.count() == 9000
    assert salted.exceptAll(plain).count() == 0
    assert plain.exceptAll(salted).count() == 0
    named = salted.where(F.col("k").isNull()).select("name").distinct().collect()
    assert [r[0] for r in named] == ([-1] if null_safe else [None])


def test_hot_list_is_bounded_and_scales_with_frequency(spark):
    counts = key_counts(facts(spark), ["k"])
    hot = {r["k"]: r["_salts"] for r in hot_keys(counts, ["k"], 0.01, 10).collect()}
    assert hot[7] >= 33 and len(hot) <= 100
    assert set(hot) == {7, None}
    assert hot_keys(counts, ["k"]).count() == 0
    assert HOT_SHARE == 1 / 2000


def test_hot_rows_are_spread_over_tasks(spark):
    before = {
        name: spark.conf.get(name)
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left, right = facts(spark), lookup(spark)

        def largest(df):
            sizes = df.groupBy(F.spark_partition_id()).count().collect()
            return max(r["count"] for r in sizes)

        plain = largest(lookup_join(left, right, ["k"], hot_share=None))
        salted = largest(lookup_join(left, right, ["k"], hot_share=0.01, min_hot_rows=10))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert plain > 3000
    assert salted < plain / 2


def test_lifecycles_with_a_hot_task_and_a_hot_collection(spark):
    usage = frames.usage(
        spark,
        [{"start_time": i * W, "collection_id": 5, "instance_index": 1} for i in range(60)]
        + [{"start_time": i * W, "collection_id": 6, "instance_index": i} for i in range(60)]
        + [{"start_time": i * W, "collection_id": 100 + i, "instance_index": None} for i in range(30)]
        + [{"start_time": i * W, "collection_id": None, "instance_index": 0} for i in range(30)],
    )
    collections = frames.collection_events(
        spark,
        [{"collection_id": c, "type": 0, "time": c, "priority": c} for c in (5, 6, *range(100, 120))],
    )
    instances = frames.instance_events(
        spark,
        [{"collection_id": 6, "instance_index": i, "type": 3, "time": 1000 + i} for i in range(0, 60, 2)],
    )
    tasks = lifecycle.placed_tasks(usage, frames.machines(spark))
    salted = lifecycle.with_lifecycles(tasks, collections, instances, hot_share=0.05, min_hot_rows=3)
    plain = lifecycle.with_lifecycles(tasks, collections, instances, hot_share=None)
    assert salted.count() == 180
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    by_hand = {r["collection_id"]: r for r in salted.where("instance_index IS NULL").collect()}
    assert by_hand[110]["collection_priority"] == 110
    assert by_hand[125]["collection_priority"] is None
    assert salted.where("collection_id IS NULL AND collection_priority IS NOT NULL").count() == 0
    started = salted.where("instance_start_time IS NOT NULL")
    assert started.count() == 30


@pytest.fixture()
def plain_plans(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_task_rows_are_shuffled_once(spark, plain_plans):
    usage = frames.usage(spark, [{"start_time": i * W, "collection_id": i % 4, "instance_index": i % 3} for i in range(20)])
    collections = frames.collection_events(spark, [{"collection_id": c, "type": 0, "time": c} for c in range(4)])
    instances = frames.instance_events(spark, [{"collection_id": c, "instance_index": 0, "type": 3, "time": 5} for c in range(4)])
    states = lifecycle.task_states(usage, frames.machines(spark), collections, instances)
    lines = states._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in lines if "SortMergeJoin" in line], "a join shuffles the rows of tasks"
    assert [line for line in lines if "Exchange hashpartitioning(collection_id" in line and "_salt" in line]
    assert states.where("instance_start_time = 5").count() == 7


def nested(spark):
    """Half of the facts are of group 7, a quarter of its member 3; some keys and looked up values are NULL."""
    facts = spark.range(0, 8000, 1, 32).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 300).cast("long").alias("g"),
        F.when(F.col("id") % 4 == 0, 3).when(F.col("id") % 14 == 2, None).otherwise(F.col("id") % 90).cast("long").alias("m"),
        F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id")).alias("v"),
    )
    ids = spark.createDataFrame([(None,), (-1,)], "id long")
    groups = spark.range(200).unionByName(ids).select(F.col("id").alias("g"), F.nullif(F.col("id") % 9, F.lit(0)).alias("a"), F.lit(1).alias("b"))
    members = groups.select("g").crossJoin(spark.range(60).unionByName(ids).select(F.col("id").alias("m")))
    return facts, groups, members.where("g is null or g % 3 < 2").withColumn("c", F.nullif(F.col("g") * 100 + F.col("m"), F.lit(703)))


@pytest.mark.parametrize("hot_share, min_hot_rows", [(0.01, 10), (0.2, 10), (HOT_SHARE, 10**6)])
def test_nested_join_equals_two_joins(spark, hot_share, min_hot_rows):
    facts, groups, members = nested(spark)
    got = nested_lookup_join(facts, groups, ["g"], members, ["g", "m"], hot_share=hot_share, min_hot_rows=min_hot_rows)
    want = facts.join(groups, ["g"], "left").join(members, ["g", "m"], "left").select("g", "m", "v", "a", "b", "c")
    assert got.columns == want.columns and got.dtypes == want.dtypes and got.count() == 8000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_groups_and_members_are_spread(spark, plain_plans):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        facts, groups, members = nested(spark)
        spread = nested_lookup_join(facts, groups, ["g"], members, ["g", "m"], hot_share=0.005, min_hot_rows=10)
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 8000 and max(sizes) < 1300
