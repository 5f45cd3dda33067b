import pytest
from pyspark.sql import functions as F

from gridlapse.functions.expressions import coerce_numeric, first_present, greatest_or_null
from gridlapse.operators import flex, lifecycle
from gridlapse.schema import FLEX_WINDOW_COLUMNS, TASK_TRACE_COLUMNS
from tests import frames
from tests.frames import W, at


def test_text_that_is_not_a_number_becomes_null(spark):
    df = spark.createDataFrame([("7", "1.5"), ("x", "nan"), (None, "")], "a string, b string")
    assert [tuple(r) for r in coerce_numeric(df, {"a": "bigint", "b": "double"}).collect()] == [
        (7, 1.5),
        (None, None),
        (None, None),
    ]


def test_first_present_and_runtime_floor(spark):
    df = spark.createDataFrame([(None, 5, 9)], "a long, b long, c long")
    assert df.select(first_present(["a", "b", "c"], 0)).first()[0] == 5
    assert df.select(first_present(["a"], 0)).first()[0] == 0
    floor = spark.createDataFrame([(10,), (None,)], "x long").select(greatest_or_null(F.col("x"), W))
    assert [r[0] for r in floor.collect()] == [W, None]


def one(df, *columns):
    row = df.first()
    return tuple(row[c] for c in columns)


def test_unknown_class_is_never_flexible(spark):
    states = flex.build_task_states(frames.task_trace(spark, [{"collection_scheduling_class": None}]))
    assert one(states, "effective_scheduling_class", "is_flex_candidate") == (99, False)


def test_critical_and_deferrable_by_slack(spark):
    trace = frames.task_trace(spark, [{}])
    tight = flex.build_task_states(trace, rho=1.5)
    assert one(tight, "actual_runtime_us", "proxy_deadline_us", "remaining_slack_us") == (
        W,
        1.5 * W,
        -0.5 * W,
    )
    assert one(tight, "is_critical", "is_deferrable", "is_online_like") == (True, False, False)
    loose = flex.build_task_states(trace, rho=3.0)
    assert one(loose, "remaining_slack_us", "is_critical", "is_deferrable") == (W, False, True)


def test_unknown_slack_is_neither_but_stays_a_candidate(spark):
    states = flex.build_task_states(frames.task_trace(spark, [{"end_time": None}]), default_time=None)
    assert one(states, "is_flex_candidate", "is_critical", "is_deferrable") == (True, None, None)
    window = flex.flex_windows(states).first()
    assert window["critical_task_count"] == window["deferrable_task_count"] == 0
    assert window["critical_cpu_usage"] == window["flex_cpu_usage"] == 0.0
    assert window["batch_candidate_cpu_usage"] == 1.0


def test_batch_scheduler_requirement_is_a_choice(spark):
    trace = frames.task_trace(spark, [{"preferred_scheduler": 0}])
    assert one(flex.build_task_states(trace), "is_flex_candidate") == (False,)
    free = flex.build_task_states(trace, require_batch_scheduler=False)
    assert one(free, "is_flex_candidate") == (True,)


def test_alloc_and_job_flags(spark):
    rows = [
        {"collection_id": 1, "alloc_collection_id": None},
        {"collection_id": 2, "alloc_collection_id": 0, "collection_type": 1},
        {"collection_id": 3, "alloc_collection_id": 4, "collection_type": None},
    ]
    states = flex.build_task_states(frames.task_trace(spark, rows)).orderBy("collection_id").collect()
    assert [r["in_alloc_set"] for r in states] == [False, False, True]
    assert [r["is_job"] for r in states] == [True, False, True]


def test_window_measures_and_ratios(spark):
    rows = [
        {"collection_id": 1, "avg_cpu_usage": 2.0, "preferred_scheduler": 0, "dependency_count": 3},
        {"collection_id": 2, "avg_cpu_usage": 1.0, "instance_submit_time": 10 * W},
        {"collection_id": 2, "avg_cpu_usage": 1.0, "machine_id": 5},
    ]
    windows = flex.flex_windows(flex.build_task_states(frames.task_trace(spark, rows)))
    assert windows.columns == list(FLEX_WINDOW_COLUMNS)
    row = windows.first()
    assert (row["online_cpu_ratio"], row["flex_cpu_ratio"], row["critical_cpu_ratio"]) == (0.5, 0.25, 0.25)
    assert row["batch_candidate_cpu_usage"] == 2.0
    assert (row["task_count"], row["job_count"], row["machine_count"]) == (3, 2, 2)
    assert row["max_dependency_count"] == 3 and row["mean_scheduling_class"] == 0.0
    assert row["measured_power_util"] == 0.5


def test_mean_slack_without_deferrable_tasks(spark):
    states = flex.build_task_states(frames.task_trace(spark, [{}]))
    assert flex.flex_windows(states).first()["mean_deferrable_slack_us"] is None
    zeroed = flex.flex_windows(states, null_slack_as_zero=True)
    assert zeroed.first()["mean_deferrable_slack_us"] == 0.0


def test_published_counts_add_up(spark):
    """Candidates are deferrable or critical, and CPU shares sum to one, when slack is known."""
    rows = [
        {
            "collection_id": i,
            "window_index": i % 3,
            "avg_cpu_usage": 0.5 + i % 7,
            "collection_scheduling_class": i % 4,
            "preferred_scheduler": i % 2,
            "instance_submit_time": (i % 11) * W // 2,
        }
        for i in range(120)
    ]
    states = flex.build_task_states(frames.task_trace(spark, rows))
    summary = flex.task_state_summary(states).first()
    assert summary["flex_candidate_rows"] == summary["deferrable_rows"] + summary["critical_rows"]
    assert summary["online_like_rows"] + summary["flex_candidate_rows"] == summary["task_rows"] == 120
    assert summary["deferrable_rows"] > 0 and summary["critical_rows"] > 0
    for row in flex.flex_windows(states).collect():
        parts = row["online_cpu_usage"] + row["flex_cpu_usage"] + row["critical_cpu_usage"]
        assert parts == pytest.approx(row["total_cpu_usage"])
        shares = row["online_cpu_ratio"] + row["flex_cpu_ratio"] + row["critical_cpu_ratio"]
        assert shares == pytest.approx(1.0)
    mix = [(r[0], r[1]) for r in flex.scheduling_class_mix(states).collect()]
    assert mix == [(0, 30), (1, 30), (2, 30), (3, 30)]


def test_trace_and_direct_path_agree(spark):
    usage = frames.usage(
        spark,
        [
            {"start_time": i * W, "collection_id": i % 3, "instance_index": i % 2, "cpu": 1.0 + i}
            for i in range(12)
        ]
        + [{"start_time": W, "collection_id": 2, "instance_index": None, "cpu": 0.25}],
    )
    collections = frames.collection_events(
        spark,
        [
            {"collection_id": c, "type": t, "time": c * W + t, "scheduling_class": c, "scheduler": 1}
            for c in range(3)
            for t in (0, 3)
        ],
    )
    instances = frames.instance_events(
        spark, [{"collection_id": 1, "instance_index": 1, "type": 4, "time": 5 * W}]
    )
    power = frames.power(spark, [{"time": i * W, "measured_power_util": i / 100} for i in range(12)])
    machines = frames.machines(spark)
    trace = lifecycle.task_trace(usage, machines, collections, instances, power)
    assert trace.columns == list(TASK_TRACE_COLUMNS)
    orphan = trace.where(F.col("instance_index").isNull()).first()
    assert orphan["collection_scheduling_class"] == 2
    two_steps = flex.flex_windows(flex.build_task_states(trace, default_time=None))
    direct = flex.flexibility_table(usage, machines, collections, instances, power)
    order = ["window_index"]
    assert two_steps.orderBy(order).collect() == direct.orderBy(order).collect()
    assert direct.count() == 12


def test_summaries(spark):
    rows = [{"window_index": i, "window_start": at(i * W), "avg_cpu_usage": 1.0 + i, "measured_power_util": 0.1 * i} for i in range(4)]
    windows = flex.flex_windows(flex.build_task_states(frames.task_trace(spark, rows)))
    summary = flex.flex_dataset_summary(windows).first()
    assert (summary["row_count"], summary["pdu_count"]) == (4, 1)
    assert (summary["window_index_min"], summary["window_index_max"]) == (0, 3)
    assert summary["corr_total_cpu_power"] == pytest.approx(1.0)
    alone = flex.flex_dataset_summary(windows.where("window_index = 0")).first()
    assert alone["corr_total_cpu_power"] != alone["corr_total_cpu_power"]
    assert flex.flex_ratio_by_pdu(windows).first()["critical_cpu_ratio"] == 1.0


def joined_inputs(spark, windows=3):
    data = frames.series(spark, [("pdu1", i, 0.5, 10) for i in range(windows)])
    rows = [{"window_index": i, "window_start": at(i * W)} for i in range(windows)]
    return data, flex.flex_windows(flex.build_task_states(frames.task_trace(spark, rows)))


def test_join_prefixes_names_that_collide(spark):
    data, windows = joined_inputs(spark)
    joined = flex.join_flex_features(data, windows)
    assert joined.count() == 3
    added = joined.columns[len(data.columns) :]
    assert "flex_window_machine_count" in added and "flex_window_total_cpu_usage" in added
    assert "task_count" in added and "window_index" in added
    assert len(added) == 21
    assert joined.first()["machine_count"] == 2


def test_join_refuses_repeated_keys_and_missing_rows(spark):
    data, windows = joined_inputs(spark)
    with pytest.raises(Exception, match="not one-to-one"):
        flex.join_flex_features(data.unionByName(data), windows).collect()
    with pytest.raises(Exception, match="not one-to-one"):
        flex.join_flex_features(data, windows.unionByName(windows)).collect()
    with pytest.raises(Exception, match="no flexibility window"):
        flex.join_flex_features(data, windows.where("window_index < 2")).collect()
    unchecked = flex.join_flex_features(data, windows.where("window_index < 2"), check=False)
    assert unchecked.where("task_count IS NULL").count() == 1


def test_untyped_trace_gives_the_same_windows(spark):
    trace = frames.task_trace(spark, [{"window_index": i, "window_start": at(i * W)} for i in range(3)])
    text = trace.select([F.col(c).cast("string").alias(c) for c in trace.columns]).withColumn(
        "window_index", F.col("window_index").cast("long")
    )
    typed, untyped = (flex.flex_windows(flex.build_task_states(t)) for t in (trace, text))
    assert untyped.dtypes == typed.dtypes
    assert untyped.exceptAll(typed).count() == 0 and untyped.count() == 3
