"""Streams of trace files against the batch rollups on the same rows."""

from pyspark.sql import functions as F

from gridlapse.operators import rollup
from gridlapse.streaming import rollup as streaming
from tests import frames
from tests.frames import W


def run(spark, tmp_path, source, schema, make, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / name)
    streaming.append_to(make(stream), out, out + "-state").awaitTermination()
    return spark.read.parquet(out)


def rows_of(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_power_with_late_rows(spark, tmp_path):
    source = str(tmp_path / "power")
    batches = [[0, 1, 2, 3], [4, 1, 5, 6], [9, 10], [2, 12]]  # a third of a window each; 1 is late but in time, 2 is too late
    for batch in batches:
        rows = [{"time": k * W // 3 + 1, "cell": "e", "pdu": "p", "measured_power_util": float(k + 1), "production_power_util": 1.0} for k in batch]
        frames.power(spark, rows).coalesce(1).write.mode("append").parquet(source)
    stored = spark.read.parquet(source)
    got = run(spark, tmp_path, source, stored.schema, lambda s: streaming.power_windows(s, delay="5 minutes"), "out")
    times = [k for batch in batches for k in batch][:-2] + [12]
    kept = frames.power(spark, [{"time": k * W // 3 + 1, "cell": "e", "pdu": "p", "measured_power_util": float(k + 1), "production_power_util": 1.0} for k in times])
    closed = rollup.power_rollup(kept).where(F.col("window_index") < 3)
    columns = ["cell", "pdu", "window_index", "measured_power_util", "production_power_util"]
    assert rows_of(got, columns) == rows_of(closed, columns) and got.count() == 3


def test_usage_goes_on_from_its_state(spark, tmp_path):
    source = str(tmp_path / "usage")
    rows = [{"start_time": k * W // 7, "collection_id": None if k % 9 == 0 else k % 5, "machine_id": k % 3, "cpu": float(k % 4)} for k in range(60)]
    for part in (rows[:25], rows[25:]):
        placed = frames.usage(spark, part).withColumns({"cell": F.lit("e"), "pdu": F.lit("p")})
        placed.coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        sums = run(spark, tmp_path, source, schema, lambda s: streaming.usage_sums(s, delay="0 seconds"), "sums")
        members = run(spark, tmp_path, source, schema, lambda s: streaming.usage_members(s, delay="0 seconds"), "members")
    got = streaming.with_members(sums, members)
    batch = rollup.usage_rollup(spark.read.parquet(source))
    closed = batch.where((F.col("window_index") + 1) * W <= 59 * W // 7)
    assert rows_of(got, batch.columns) == rows_of(closed, batch.columns) and closed.count() == 8
