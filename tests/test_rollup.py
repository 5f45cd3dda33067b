import pytest
from pyspark.sql import functions as F

from gridlapse.functions.buckets import in_window_range, window_index, window_start
from gridlapse.functions.expressions import good_power, min_duration, not_in_alloc
from gridlapse.operators import coverage, lifecycle, rollup
from gridlapse.schema import TRAINING_COLUMNS, feature_set, require_columns
from tests import frames
from tests.frames import W


def test_bucket_is_floor_of_float_division(spark):
    times = spark.createDataFrame([(0,), (W - 1,), (W,), (2 * W + 1,), (-1,)], "t long")
    rows = times.select(window_index("t")).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 2, -1]
    assert times.select(window_index("t")).dtypes[0][1] == "bigint"


def test_window_start_is_trace_relative(spark):
    row = spark.range(1).select(F.unix_micros(window_start(F.lit(1500)))).first()
    assert row[0] == 1500 * W


def test_window_range_is_inclusive_and_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "times.parquet")
    spark.range(0, 100).select((F.col("id") * (W // 4)).alias("t")).write.parquet(path)
    kept = spark.read.parquet(path).where(in_window_range("t", 2, 4))
    assert sorted(r[0] // W for r in kept.collect()) == [2] * 4 + [3] * 4 + [4] * 4
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThan(t" in plan


def test_alloc_filter_keeps_null_and_zero(spark):
    df = spark.createDataFrame([(None,), (0,), (7,)], "alloc_collection_id long")
    assert [r[0] for r in df.where(not_in_alloc()).collect()] == [None, 0]


def test_min_duration_and_power_flags(spark):
    df = frames.usage(spark, [{"end_time": W}, {"end_time": W - 1}])
    assert df.where(min_duration()).count() == 1
    flags = [(False, False), (True, False), (False, True), (None, False), (False, None)]
    readings = frames.power(
        spark,
        [
            {"time": 0, "bad_measurement_data": a, "bad_production_power_data": b}
            for a, b in flags
        ],
    )
    assert readings.where(good_power()).count() == 1


def test_power_windows_without_usage_are_kept_with_zeros(spark):
    table = rollup.pdu_training_table(
        frames.power(spark, [{"time": 10 * W}, {"time": 11 * W}]),
        frames.usage(spark, [{"start_time": 10 * W + 5, "cpu": 2.0}, {"start_time": 10 * W, "cpu": 4.0}]),
        frames.machines(spark),
    )
    assert table.columns == list(TRAINING_COLUMNS)
    rows = {r["window_start"].minute: r for r in table.collect()}
    full, empty = rows[50], rows[55]
    assert (full["instance_count"], full["total_cpu_usage"], full["max_cpu_usage"]) == (2, 6.0, 4.0)
    assert (full["collection_count"], full["machine_count"]) == (1, 1)
    assert (empty["instance_count"], empty["machine_count"], empty["total_cpu_usage"]) == (0, 0, 0.0)
    assert empty["measured_power_util"] == 0.5


def test_scope_and_filters_of_the_training_table(spark):
    power = frames.power(spark, [{"time": i * W, "pdu": p} for i in range(4) for p in ("pdu1", "pdu2")])
    usage = frames.usage(
        spark,
        [
            {"start_time": W},
            {"start_time": W, "alloc_collection_id": 9},
            {"start_time": 2 * W, "machine_id": 2},
        ],
    )
    machines = frames.machines(spark, [{"machine_id": 1}, {"machine_id": 2, "pdu": "pdu2"}])

    def counts(**options):
        rows = rollup.pdu_training_table(power, usage, machines, **options).collect()
        return {(r["pdu"], int(r["window_start"].minute / 5)): r["instance_count"] for r in rows}

    assert counts()[("pdu1", 1)] == 2
    assert counts(exclude_alloc=True)[("pdu1", 1)] == 1
    assert counts(cell="f", pdus=["pdu2"], low=1, high=2) == {("pdu2", 1): 0, ("pdu2", 2): 1}
    assert counts(cell="g") == {}


def test_exact_variant_joins_on_the_raw_time(spark):
    table = rollup.pdu_training_table_exact(
        frames.power(spark, [{"time": W}, {"time": W}, {"time": W + 1, "bad_measurement_data": True}]),
        frames.usage(spark, [{"start_time": W}, {"start_time": W, "end_time": 2 * W - 1}]),
        frames.machines(spark),
    )
    assert sorted((r["window_start"], r["instance_count"]) for r in table.collect()) == [
        (W, 1),
        (W, 1),
        (W + 1, 0),
    ]


def test_priority_is_the_maximum_outside_alloc_sets(spark):
    events = frames.instance_events(
        spark,
        [
            {"type": 0, "time": 0, "priority": 5},
            {"type": 1, "time": 1, "priority": 9},
            {"type": 1, "time": 2, "priority": 99, "alloc_collection_id": 3},
        ],
    )
    usage = frames.usage(spark, [{}, {"instance_index": 8}])
    rows = rollup.usage_with_priority(usage, events, frames.machines(spark)).collect()
    assert sorted((r["instance_index"], r["priority"]) for r in rows) == [(0, 9), (8, None)]


def test_lifecycle_end_events_differ(spark):
    kinds = [{"type": 4, "time": 10}, {"type": 6, "time": 20}]
    collection = lifecycle.collection_lifecycle(frames.collection_events(spark, kinds)).first()
    instance = lifecycle.instance_lifecycle(frames.instance_events(spark, kinds)).first()
    assert collection["collection_end_time"] == 20
    assert instance["instance_end_time"] == 10


def test_dependency_count_is_null_without_a_list(spark):
    events = frames.collection_events(
        spark,
        [
            {"type": 0, "time": 0, "start_after_collection_ids": [4, 5]},
            {"type": 0, "time": 0, "collection_id": 2},
        ],
    )
    counts = {
        r["collection_id"]: r["dependency_count"]
        for r in lifecycle.collection_lifecycle(events).collect()
    }
    assert counts == {1: 2, 2: None}


def test_lifecycles_can_be_restricted_to_used_collections(spark):
    events = frames.collection_events(spark, [{"type": 0, "time": 0, "collection_id": i} for i in range(5)])
    usage = frames.usage(spark, [{"collection_id": 3}, {"collection_id": 3}, {"collection_id": 9}])
    kept = lifecycle.collection_lifecycle(events, usage).collect()
    assert [r["collection_id"] for r in kept] == [3]
    assert lifecycle.restrict_to_collections(events, usage).count() == 1


def test_coverage_and_tiers(spark):
    power = frames.power(spark, [{"time": i * W} for i in range(4)])
    placed = rollup.usage_on_machines(
        frames.usage(spark, [{"start_time": i * W + 7} for i in range(3)]), frames.machines(spark)
    )
    by_pdu = coverage.join_coverage_by_pdu(
        coverage.power_windows(power), coverage.usage_windows(placed)
    ).first()
    assert (by_pdu["power_windows"], by_pdu["matched_usage_windows"]) == (4, 3)
    assert by_pdu["unmatched_usage_windows"] == 1 and by_pdu["matched_ratio"] == 0.75
    exact = coverage.join_coverage(power, coverage.usage_start_times(placed)).first()
    assert (exact["matched_windows"], exact["matched_ratio"]) == (0, 0.0)
    nothing = coverage.join_coverage(power.where("false"), coverage.usage_start_times(placed)).first()
    assert nothing["total_power_windows"] == 0 and nothing["matched_ratio"] is None

    cases = [(0.99, 300), (0.99, 250), (0.91, 150), (0.99, 100)]
    df = spark.createDataFrame(cases, "matched_ratio double, matched_usage_windows long")
    assert [r[0] for r in df.select(coverage.tier()).collect()] == [
        "strong_dev_candidate",
        "usable_dev_candidate",
        "holdout_or_backup_candidate",
        "drop_for_now",
    ]


def test_quality_counts_duplicates_of_null_keys(spark):
    df = spark.createDataFrame(
        [("a", "p", 1, 1.0), ("a", "p", 1, None), ("b", "p", 1, float("nan")), (None, None, None, 3.0)],
        "cell string, pdu string, w long, label double",
    ).withColumn("window_start", F.timestamp_micros("w"))
    row = coverage.quality_summary(df, "label").first()
    assert (row["row_count"], row["duplicate_rows"]) == (4, 1)
    assert (row["min_label"], row["max_label"]) == (1.0, 3.0)
    assert (row["null_cells"], row["null_pdus"], row["null_windows"]) == (1, 1, 1)
    rates = {r["column_name"]: r["missing_rate"] for r in coverage.missing_rates(df).collect()}
    assert rates["label"] == 0.5 and rates["cell"] == 0.25


def test_names_are_checked_without_a_job(spark):
    with pytest.raises(ValueError, match="avg_cpu_usage"):
        require_columns(spark.range(1).withColumnRenamed("id", "cell"), TRAINING_COLUMNS)
    sizes = {name: len(feature_set(name)) for name in ("legacy", "cyclic", "compact", "enhanced", "flex")}
    assert sizes == {"legacy": 11, "cyclic": 13, "compact": 16, "enhanced": 18, "flex": 27}
    with pytest.raises(ValueError, match="No feature set"):
        feature_set("other")
