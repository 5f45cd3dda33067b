import pytest
from pyspark.sql import functions as F

from gridlapse import flows
from gridlapse.operators import features, rollup
from gridlapse.plans.stage import CHECKPOINT_CONF, stage, stage_directory
from tests import frames
from tests.frames import W


def raw_tables(spark, windows=20):
    power = frames.power(spark, [{"time": i * W, "measured_power_util": 0.5 + i / 100} for i in range(windows)])
    usage = frames.usage(
        spark,
        [{"start_time": i * W + 3, "collection_id": i % 4, "cpu": 1.0 + i} for i in range(windows)],
    )
    return power, usage, frames.machines(spark)


def test_flow_equals_its_steps(spark):
    tables = raw_tables(spark)
    flow = flows.training_dataset(*tables, cell="f", pdus=["pdu1"], low=2, high=15)
    table = rollup.pdu_training_table(*tables, cell="f", pdus=["pdu1"], low=2, high=15)
    steps = features.chronological_split(features.build_features(table))
    assert flow.columns == steps.columns and flow.count() == 14
    assert flow.exceptAll(steps).count() == 0


def test_flow_with_flex_features(spark):
    tables = raw_tables(spark)
    collections = frames.collection_events(
        spark,
        [{"collection_id": c, "type": 0, "time": 0, "scheduling_class": c, "scheduler": 1} for c in range(4)],
    )
    instances = frames.instance_events(spark, [])
    joined = flows.flex_training_dataset(*tables, collections, instances)
    assert joined.count() == 20
    row = joined.where(F.col("window_index") == 5).first()
    assert row["task_count"] == 1 and row["flex_window_machine_count"] == 1
    assert row["flex_window_total_cpu_usage"] == row["total_cpu_usage"] == 6.0


def test_stage_writes_below_the_named_folder(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    staged = stage(df, "numbers")
    assert staged.exceptAll(df).count() == 0
    assert f"{stage_directory(spark)}/numbers-" in staged.inputFiles()[0].replace("file://", "file:")
    assert "FileScan parquet" in staged._jdf.queryExecution().executedPlan().toString()


class Session:
    """Stands in for a session with the given settings."""

    def __init__(self, master, conf=None, checkpoint=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.settings, self.checkpoint = master, conf or {}, checkpoint

    def get(self, name, default):
        return self.settings.get(name, default)

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_stage_folder_comes_from_the_session(tmp_path):
    shared = {CHECKPOINT_CONF: "hdfs:///shared/"}
    assert stage_directory(Session("yarn", shared)) == "hdfs:///shared"
    assert stage_directory(Session("yarn", None, "hdfs:///other")) == "hdfs:///other"
    assert "gridlapse-" in stage_directory(Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage_directory(Session("yarn"))
