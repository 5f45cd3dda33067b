import glob
import json

import pytest
from pyspark.sql import functions as F

from gridlapse.operators import baselines, features, flex
from gridlapse.sources import readers, versions, writers
from tests import frames
from tests.frames import W, at

HEADER = "window_start,window_index,cell,pdu,task_count,flex_cpu_ratio"
LINES = [
    "1970-01-06 05:00:00 UTC,1500,f,pdu20,7,0.25",
    "1970-01-06 05:05:00+00:00,1501,f,pdu20,x,0.5",
]


def write_text(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("preamble", [[], ["DECLARE x STRING;", "SELECT a, b", "Waiting on job ... (0s)"]])
def test_csv_with_and_without_preamble(spark, tmp_path, preamble):
    path = write_text(tmp_path / "export.csv", [*preamble, HEADER, *LINES])
    rows = readers.read_csv_with_preamble(spark, path).orderBy("window_index").collect()
    assert [r["window_index"] for r in rows] == [1500, 1501]
    assert [r["task_count"] for r in rows] == [7, None]
    assert [r["flex_cpu_ratio"] for r in rows] == [0.25, 0.5]
    micros = readers.read_export(spark, path).select(F.unix_micros("window_start").alias("us"))
    assert sorted(r["us"] for r in micros.collect()) == [1500 * W, 1501 * W]
    assert readers.dropped_preamble_lines(spark, path) == len(preamble)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "exports.csv"
    folder.mkdir()
    write_text(folder / "a.csv", ["SELECT 1", HEADER, *LINES])
    other = "window_start,window_index,pdu,cell,flex_cpu_ratio,machine_count"
    write_text(folder / "b.csv", ["x,y", other, "1970-01-06 05:10:00 UTC,1502,pdu21,f,0.75,3"])
    rows = readers.read_csv_with_preamble(spark, str(folder)).orderBy("window_index").collect()
    assert [(r["pdu"], r["cell"], r["task_count"], r["flex_cpu_ratio"], r["machine_count"]) for r in rows] == [
        ("pdu20", "f", 7, 0.25, None), ("pdu20", "f", None, 0.5, None), ("pdu21", "f", None, 0.75, 3)
    ]
    assert readers.dropped_preamble_lines(spark, str(folder)) == 2
    write_text(folder / "c.csv", LINES)
    with pytest.raises(Exception, match="No header in"):
        readers.read_csv_with_preamble(spark, str(folder)).collect()


def test_a_split_export_takes_the_only_header(spark, tmp_path):
    folder = tmp_path / "export.csv"
    folder.mkdir()
    write_text(folder / "part-0.csv", ["SELECT t.window_start, count(*)", HEADER])
    write_text(folder / "part-1.csv", ["FROM tasks", *LINES])
    assert readers.read_csv_with_preamble(spark, str(folder)).count() == 2
    assert readers.dropped_preamble_lines(spark, str(folder)) == 2


@pytest.mark.parametrize("cut", ["1970-01-06 05:05:00 UTC,1501,f,pdu1", "1970-01-0", "1970-01-06 05:05:00 UTC,1501,f,pdu1,1,2,3"])
def test_a_cut_line_is_not_lost(spark, tmp_path, cut):
    path = write_text(tmp_path / "cut.csv", ["some words, one, two", HEADER, *LINES, cut])
    with pytest.raises(Exception, match="has not the header's fields: .*cut.csv"):
        readers.read_csv_with_preamble(spark, path).collect()
    assert readers.dropped_preamble_lines(spark, path) == 1


def test_a_cut_line_in_a_part_without_header(spark, tmp_path):
    folder = tmp_path / "cut.csv"
    folder.mkdir()
    write_text(folder / "part-0.csv", [HEADER, *LINES])
    write_text(folder / "part-1.csv", ["1970-01-06 05:05:00 UTC,1501,f,pdu1"])
    with pytest.raises(Exception, match="has not the header's fields"):
        readers.read_csv_with_preamble(spark, str(folder)).collect()


def test_plain_csv_and_unknown_suffix(spark, tmp_path):
    path = write_text(tmp_path / "plain.csv", ["a,b", "1,x"])
    assert readers.read_csv_with_preamble(spark, path).first().asDict() == {"a": 1, "b": "x"}
    assert readers.read_frame(spark, path).dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(ValueError, match="Cannot read"):
        readers.read_frame(spark, "table.xlsx")


def test_power_trace_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "power")
    rows = [{"time": i, "cell": c, "pdu": p} for i, (c, p) in enumerate([("e", "pdu1"), ("f", "pdu1"), ("f", "pdu2")])]
    frames.power(spark, rows).write.partitionBy("cell", "pdu").parquet(path)
    scope = readers.read_power_trace(spark, path, ["f"], ["pdu2"])
    assert [r["time"] for r in scope.collect()] == [2]
    plan = scope._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_raw_tables_round_trip(spark, tmp_path):
    usage = frames.usage(spark, [{"start_time": W, "cpu": 2.5}])
    usage.withColumn("cell", F.lit("f")).write.partitionBy("cell").parquet(str(tmp_path / "u"))
    back = readers.read_usage(spark, str(tmp_path / "u"), ["f"])
    assert back.select("average_usage.cpus", "cell").first() == (2.5, "f")
    plan = back.select("average_usage.cpus")._jdf.queryExecution().executedPlan().toString()
    assert "memory" not in plan.split("ReadSchema:")[1]
    for name, df, read in (
        ("c", frames.collection_events(spark, [{"type": 0, "time": 1, "start_after_collection_ids": [2]}]), readers.read_collection_events),
        ("i", frames.instance_events(spark, [{"type": 0, "time": 1}]), readers.read_instance_events),
        ("m", frames.machines(spark), readers.read_machine_map),
    ):
        df.write.parquet(str(tmp_path / name))
        assert read(spark, str(tmp_path / name)).collect() == df.collect()


def metadata(spark, path):
    return json.loads(spark.read.text(f"{versions.current(spark, path)}/metadata").first()[0])


def test_dataset_version(spark, tmp_path):
    data = features.chronological_split(features.build_features(frames.wavy(spark, 2, 100)))
    path = str(tmp_path / "v1")
    written = writers.write_dataset(data, path, "v1")
    assert written == metadata(spark, path)
    assert (written["train_rows"], written["val_rows"], written["test_rows"]) == (140, 30, 30)
    assert written["row_count"] == 200 and len(written["columns"]) == 25
    back = readers.read_dataset(spark, path)
    assert back.select(*data.columns).exceptAll(data).count() == 0
    assert readers.read_metadata(spark, path).first()["version"] == "v1"
    assert sorted(p.rsplit("=")[-1] for p in glob.glob(f"{versions.current(spark, path)}/data/split=*")) == ["test", "train", "val"]

    full = writers.write_dataset(data.drop("split"), str(tmp_path / "full"), "holdout")
    assert full["split_mode"] == "full_only" and full["full_rows"] == 200


def flex_inputs(spark, windows):
    rows = [{"window_index": i, "window_start": at(i * W)} for i in range(windows)]
    states = flex.build_task_states(frames.task_trace(spark, rows))
    return states, flex.flex_windows(states)


def test_flex_outputs(spark, tmp_path):
    states, windows = flex_inputs(spark, 5)
    trace = writers.write_flex_trace(states, windows, str(tmp_path / "trace"), rho=1.5)
    assert (trace["task_rows"], trace["window_rows"], trace["require_batch_scheduler"]) == (5, 5, True)
    packed = writers.write_flex_dataset(windows, str(tmp_path / "flex"))
    assert (packed["row_count"], packed["pdu_count"]) == (5, 1)
    assert (packed["window_index_min"], packed["window_index_max"]) == (0, 4)
    with pytest.raises(ValueError, match="mean_scheduling_class"):
        writers.write_flex_dataset(windows.drop("mean_scheduling_class"), str(tmp_path / "bad"))


def test_joined_dataset(spark, tmp_path):
    data = features.chronological_split(
        features.build_features(frames.series(spark, [("pdu1", i, 0.5, 10) for i in range(10)]))
    )
    _, windows = flex_inputs(spark, 10)
    path = str(tmp_path / "joined")
    written = writers.write_joined_dataset(data, windows, path, version="v1_flex", flex_path="x")
    assert written["split_mode"] == "chronological"
    assert written["split_counts"] == {"train": 7, "val": 1, "test": 2}
    assert len(written["flex_columns"]) == 20 and "window_index" not in written["flex_columns"]
    assert "flex_window_measured_power_util" in written["flex_columns"]
    assert readers.read_dataset(spark, path).count() == 10
    full = writers.write_joined_dataset(data.drop("split"), windows, str(tmp_path / "f"), version="f")
    assert full["split_mode"] == "full_only" and full["split_counts"] == {"full": 10}


def test_benchmark_files(spark, tmp_path):
    data = features.chronological_split(features.build_features(frames.wavy(spark, 2, 60)))
    metrics = baselines.fit_and_score(data, models=["persistence", "moving_average", "cpu_heuristic"])
    path = str(tmp_path / "bench")
    best = writers.write_benchmark(baselines.baseline_benchmark(metrics), path)
    stored = spark.read.csv(f"{versions.current(spark, path)}/benchmark_csv", header=True, inferSchema=True)
    assert stored.count() == 3
    assert stored.first()["model"] == best["best"]["model"]
    assert len(glob.glob(f"{versions.current(spark, path)}/benchmark_json/*.json")) == 1


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    data = features.chronological_split(features.build_features(frames.wavy(spark, 1, 40)))
    path = str(tmp_path / "v")
    writers.write_dataset(data, path, "v1")
    old = versions.current(spark, path)
    for name in ("_write_splits", "_counts", "publish"):
        with monkeypatch.context() as m:
            m.setattr(writers, name, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                writers.write_dataset(data.limit(5), path, "v2")
        assert versions.current(spark, path) == old
        assert readers.read_dataset(spark, path).count() == 40 and metadata(spark, path)["version"] == "v1"
    writers.write_dataset(data.where("split = 'test'"), path, "v3")
    assert metadata(spark, path)["version"] == "v3" and readers.read_dataset(spark, path).count() == 6
    assert len(versions.versions(spark, path)) == 4
    assert old in versions.remove_superseded(spark, path)
    assert versions.versions(spark, path) == [versions.current(spark, path)]
    assert readers.read_dataset(spark, path).count() == 6


def test_a_folder_without_versions_is_read_as_it_is(spark, tmp_path):
    frames.wavy(spark, 1, 5).write.parquet(str(tmp_path / "old" / "data"))
    assert readers.read_dataset(spark, str(tmp_path / "old")).count() == 5
    assert versions.remove_superseded(spark, str(tmp_path / "old")) == []
