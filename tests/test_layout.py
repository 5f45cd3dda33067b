"""Tables bucketed by task: the same rows, without a shuffle of them."""

import uuid

import pytest
from pyspark.sql import functions as F

from gridlapse.operators import lifecycle
from gridlapse.sources import layout
from tests import frames


def inputs(spark):
    tasks = [{"collection_id": None if k % 23 == 0 else k % 9, "instance_index": k % 4, "machine_id": k % 3, "start_time": k * frames.W} for k in range(120)]
    events = [{"collection_id": None if k % 19 == 0 else k % 11, "instance_index": k % 5, "type": k % 7, "time": k, "priority": k % 3} for k in range(200)]
    collections = [{"collection_id": k % 11, "type": k % 7, "time": k} for k in range(60)]
    machines = frames.machines(spark)
    return frames.usage(spark, tasks), frames.instance_events(spark, events), frames.collection_events(spark, collections), machines


@pytest.fixture()
def stored(spark, tmp_path):
    usage, events, _, _ = inputs(spark)
    tables = layout.write_task_tables(usage, events, f"t_{uuid.uuid4().hex}", str(tmp_path), 6)
    yield tables
    for name in (tables.usage, tables.events):
        spark.sql(f"DROP TABLE {name}")


def test_states_equal_those_of_plain_frames(spark, stored):
    usage, events, collections, machines = inputs(spark)
    want = lifecycle.task_states(usage, machines, collections, events)
    got = layout.task_states(spark, stored, machines, collections)
    assert sorted(got.columns) == sorted(want.columns)
    cells = [F.col(c).cast("string") for c in sorted(want.columns)]
    rows = [sorted(map(str, df.select(*cells).collect())) for df in (want, got)]
    assert rows[0] == rows[1] and len(rows[0]) == 40


def nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def test_task_rows_are_not_shuffled(spark, stored):
    _, _, collections, machines = inputs(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = spark.table(stored.usage).where("collection_id is not null and instance_index is not null")
        plan = plan.join(lifecycle.instance_lifecycle(spark.table(stored.events)), ["collection_id", "instance_index"])
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "SortMergeJoin" in text
        # Of the whole join, what stands left of the tasks' own join is read bucket by bucket.
        whole = layout.tasks_with_lifecycles(spark, stored, F.broadcast(machines), collections)
        joins = [n for n in nodes(whole._jdf.queryExecution().executedPlan()) if n.nodeName() == "SortMergeJoin" and "_task_collection_id" in n.simpleString(1000)]
        assert joins
        left = joins[0].children().apply(0).toString()
        assert "Bucketed: true" in left and "Exchange hashpartitioning(collection_id" not in left
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_task_rows_stay_in_their_buckets_without_a_hint(spark, stored):
    """Of the machine map Spark knows no size that it would broadcast; the written files need no sort by bucket."""
    _, _, collections, machines = inputs(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        whole = layout.tasks_with_lifecycles(spark, stored, machines, collections)
        joins = [n for n in nodes(whole._jdf.queryExecution().executedPlan()) if n.nodeName() == "SortMergeJoin" and "_task_collection_id" in n.simpleString(1000)]
        left = joins[0].children().apply(0).toString()
        assert "Bucketed: true" in left and "Exchange hashpartitioning(collection_id" not in left and "SortMergeJoin" not in left
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {stored.usage}").collect()}
    assert described["Num Buckets"] == "6" and described.get("Sort Columns", "[]") == "[]"
