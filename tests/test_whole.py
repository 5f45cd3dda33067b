"""Situations in which rows, cells or members could be lost or mixed."""

import math
import os

import pytest
from pyspark.sql import functions as F

from gridlapse.functions import expressions
from gridlapse.operators import baselines, evaluate, lifecycle, rollup
from gridlapse.plans import skew
from gridlapse.plans.stage import stage, staging
from gridlapse.schema import COLLECTION_EVENTS_SCHEMA, INSTANCE_EVENTS_SCHEMA
from gridlapse.sources import readers


# --- numbers as text, damaged lines, cells ---------------------------------------------------


def test_whole_numbers_as_text_keep_their_values(spark):
    df = spark.createDataFrame(
        [("123.0",), ("1.5e12",), (" 7 ",), ("123.5",), ("x",), (None,), ("9007199254740993",)], "n string"
    )
    got = [r.n for r in expressions.coerce_numeric(df, {"n": "bigint"}).collect()]
    assert got == [123, 1_500_000_000_000, 7, None, None, None, 9007199254740993]


HEADER = "window_start,window_index,cell,pdu,task_count"


def test_damaged_data_line_is_not_taken_for_preamble(spark, tmp_path):
    good = "2019-05-01 00:00:00 UTC,1501.0,a,p,5.0"
    (tmp_path / "good.csv").write_text("\n".join(["SELECT 1", "FROM t", HEADER, good]) + "\n")
    row = readers.read_csv_with_preamble(spark, str(tmp_path / "good.csv")).collect()
    assert [(r.window_index, r.task_count) for r in row] == [(1501, 5)]
    assert readers.dropped_preamble_lines(spark, str(tmp_path / "good.csv")) == 2
    for damaged in ("not a time,1502,a,p,5", "2019-05-01 00:00:00 UTC,,a,p,5"):
        (tmp_path / "bad.csv").write_text("\n".join(["SELECT 1", HEADER, good, damaged]) + "\n")
        with pytest.raises(Exception, match="does not parse"):
            readers.read_csv_with_preamble(spark, str(tmp_path / "bad.csv")).collect()


def test_lifecycles_count_ids_within_a_cell(spark):
    columns = "cell string, time long, collection_id long, type int, scheduling_class int, collection_type int, priority long, scheduler int, start_after_collection_ids array<long>, vertical_scaling int"
    rows = [("a", 1, 7, 0, 1, 0, 5, 1, None, 0), ("b", 9, 7, 6, 2, 0, 6, 1, [1], 0)]
    got = lifecycle.collection_lifecycle(spark.createDataFrame(rows, columns)).orderBy("cell").collect()
    assert [(r.cell, r.collection_submit_time, r.collection_end_time) for r in got] == [("a", 1, None), ("b", None, 9)]
    used = spark.createDataFrame([("a", 7)], "cell string, collection_id long")
    assert [r.cell for r in lifecycle.collection_lifecycle(spark.createDataFrame(rows, columns), used).collect()] == ["a"]


def test_usage_without_cell_fails_on_a_machine_of_two_cells(spark):
    usage = spark.createDataFrame([(1, 10), (2, 20)], "machine_id long, start_time long")
    clear = [(1, "p", "a"), (2, "q", "b")]
    schema = "machine_id long, pdu string, cell string"
    placed = rollup.usage_on_machines(usage, spark.createDataFrame(clear, schema))
    assert sorted((r.machine_id, r.cell) for r in placed.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="several have machine"):
        rollup.usage_on_machines(usage, spark.createDataFrame([*clear, (1, "p", "b")], schema)).collect()


# --- incomplete predictions ------------------------------------------------------------------


def test_missing_predictions_make_metrics_nan(spark):
    rows = [("m", 1.0, 1.5), ("m", 2.0, None), ("n", 1.0, 1.5), ("n", 2.0, 2.0), ("o", 1.0, math.nan), ("p", None, 1.0)]
    got = {r.model: r for r in evaluate.regression_metrics(spark.createDataFrame(rows, "model string, y double, prediction double"), ["model"]).collect()}
    for name in ("m", "o", "p"):
        assert all(math.isnan(got[name][x]) for x in ("mae", "rmse", "mape", "smape", "r2"))
    assert got["n"].mae == 0.25 and got["m"].sample_count == 2


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a", 1.0, 1.0), (1, "b", 1.0, 3.0), (2, "a", 1.0, 1.0)],
        [(1, "a", 1.0, 1.0), (1, "a", 1.0, 1.0), (2, "a", 1.0, 1.0), (2, "b", 1.0, 1.0)],
        [(1, "a", 1.0, 1.0), (1, "b", 1.0, None)],
        [(1, "a", 1.0, 1.0), (1, "b", math.nan, 1.0)],
    ],
)
def test_ensemble_refuses_incomplete_rows(spark, rows):
    predictions = spark.createDataFrame(rows, "id int, model string, y double, prediction double")
    with pytest.raises(Exception, match="(?i)ensemble member"):
        evaluate.ensemble_mean(predictions, ["id"]).collect()


def test_no_salt_gets_more_rows_than_the_bound(spark):
    counts = spark.createDataFrame([(1, 5000), (2, 900), (3, 90)], "k int, _key_rows long")
    hot = {r.k: r._salts for r in skew.hot_keys(counts, ["k"], 0.5, 100, 200).collect()}
    assert hot == {1: 25, 2: 5}


def test_forest_does_not_depend_on_the_shuffle_partitions(spark):
    rows = [(i % 24, i % 7, math.sin(i) + i % 5) for i in range(600)]
    train = spark.createDataFrame(rows, "hour int, day_of_week int, y double")
    sums = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spread = baselines.spread(train)
        sums.append([tuple(r) for r in spread.collect()])
        assert spread.rdd.getNumPartitions() == baselines.TREE_PARTITIONS
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sums[0] == sums[1]


def test_staged_data_goes_with_its_block(spark):
    with staging(spark) as folder:
        kept = stage(spark.range(5), "numbers")
        assert kept.count() == 5 and all(folder in f for f in kept.inputFiles())
        local = folder.removeprefix("file:")
        assert os.path.isdir(local)
    assert not os.path.exists(local)
    assert folder not in stage(spark.range(2)).inputFiles()[0]


def test_scoped_trace_leaves_out_other_events_before_aggregating(spark):
    tasks = spark.createDataFrame([("a", 1, 0)], "cell string, collection_id long, instance_index long")
    tasks = tasks.withColumn("collection_type", F.lit(None).cast("long"))
    collections = spark.createDataFrame([], COLLECTION_EVENTS_SCHEMA)
    instances = spark.createDataFrame([], INSTANCE_EVENTS_SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            lifecycle.with_lifecycles(tasks, collections, instances, scoped=scoped, hot_share=None)
            ._jdf.queryExecution().optimizedPlan().toString()
            for scoped in (False, True)
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [plan.count("LeftSemi") for plan in plans] == [0, 2]
    lines = plans[1].splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(lines)}
    for i in [i for i, line in enumerate(lines) if "LeftSemi" in line]:
        above = [k for k in range(i) if depth[k] < depth[i] and "min(CASE" in lines[k]]
        assert above, "the events are aggregated before the semi-join"
