"""Forests: independent of layout, and their node tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlapse.operators import baselines, trees


def rows(spark, n=600):
    some = np.random.default_rng(2)
    a, b, c = some.normal(size=n), some.integers(0, 3, n), some.normal(size=n)
    y = np.where(a > 0.3, 2.0, -1.0) + b + 0.05 * some.normal(size=n)
    return spark.createDataFrame([(float(p), int(q), float(r), float(t)) for p, q, r, t in zip(a, b, c, y)], "a double, b int, c double, y double")


FEATURES = ("a", "b", "c")


def fitted(df, **options):
    return trees.fit_forest(df, FEATURES, "y", **{"trees": 8, "depth": 4, **options})


def same(one, other):
    return all(np.array_equal(getattr(one, f), getattr(other, f)) for f in ("feature", "threshold", "value", "weight"))


def test_layout_and_order_change_nothing(spark, monkeypatch):
    df = rows(spark)
    one = fitted(df.repartition(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(trees, "FILES", 3)
    monkeypatch.setattr(trees, "HELD", 4000)
    monkeypatch.setattr(trees, "NODES", 1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert same(one, fitted(df.orderBy("c").repartition(9)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not same(one, fitted(df, seed=7))


def test_it_learns_steps(spark):
    df = rows(spark)
    scored = fitted(df, trees=20).predict(df)
    assert scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.2
    assert scored.columns == [*df.columns, "prediction"]


def test_the_node_table_is_the_model(spark):
    df = rows(spark, 200)
    model = fitted(df, trees=3)
    nodes = model.nodes(spark)
    again = trees.Forest.from_nodes(nodes, FEATURES)
    assert same(again, trees.Forest.from_nodes(again.nodes(spark), FEATURES))
    want = [r.prediction for r in model.predict(df).collect()]
    assert [r.prediction for r in again.predict(df).collect()] == want
    # Replayed by joins, a level at a time.
    at = df.withColumn("id", F.monotonically_increasing_id()).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("tree"))).withColumn("node", F.lit(1))
    for _ in range(4):
        step = at.join(nodes, ["tree", "node"])
        x = F.create_map(*[c for f in FEATURES for c in (F.lit(f), F.col(f).cast("double"))])[F.col("feature")]
        at = step.select("id", *FEATURES, "tree", F.when(F.col("feature").isNull(), F.col("node")).when(x <= F.col("threshold"), F.col("left")).otherwise(F.col("right")).alias("node"))
    replayed = at.join(nodes, ["tree", "node"]).groupBy("id").agg(F.avg("value").alias("p")).orderBy("id").collect()
    assert np.allclose([r.p for r in replayed], want)
    inner = nodes.where("feature is not null")
    assert inner.where("left <> 2 * node or right <> 2 * node + 1").count() == 0


def test_missing_numbers_and_odd_labels(spark):
    df = rows(spark, 300).withColumn("a", F.when(F.col("c") > 1, None).otherwise(F.col("a")))
    model = fitted(df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("double"))))
    assert same(model, fitted(df))
    assert model.predict(df.where("a is null")).where("isnan(prediction) or prediction is null").count() == 0
    flat = fitted(df.withColumn("y", F.lit(3.0)))
    assert (flat.feature < 0).all() and abs(flat.predict(df).first()["prediction"] - 3.0) < 1e-6
    assert fitted(df.withColumn("y", F.lit(0.0))).predict(df).first()["prediction"] == 0.0
    with pytest.raises(ValueError, match="no rows"):
        fitted(df.where("y > 1e9"))
    with pytest.raises(ValueError, match="not a number"):
        fitted(df.withColumn("y", F.lit(float("nan"))))


def test_bins():
    x = np.column_stack([np.arange(100.0), np.repeat([1.0, 5.0], 50)])
    cuts = trees.cuts_of(x, 8)
    assert len(cuts[0]) == 7 and cuts[1].tolist() == [1.0]
    found = trees.binned(np.array([[-1.0, 1.0], [1000.0, 5.0], [np.nan, np.nan]]), cuts)
    assert found.tolist() == [[0, 0], [7, 1], [7, 1]]


def test_spread_follows_the_number_of_rows(spark, monkeypatch):
    df = rows(spark, 100)
    assert baselines.spread(df).rdd.getNumPartitions() == baselines.TREE_PARTITIONS
    monkeypatch.setattr(baselines, "TREE_ROWS", 2)
    assert baselines.spread(df).rdd.getNumPartitions() == 50
