"""Least squares on lagged rows: sums against written-out windows, models against Spark's."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gridlapse.operators import forecast, lagged
from gridlapse.operators.sequence import flatten_lags, sequence_windows
from gridlapse.plans.blocks import Series
from tests.frames import W, at

SCHEMA = "cell string, pdu string, window_start timestamp, a double, b double, y double"
SMALL = Series(block_us=7 * W)


def rows(spark, lengths=(40, 3, 4, 5, 1), gap=True):
    some = np.random.default_rng(5)
    out = []
    for s, n in enumerate(lengths):
        for k in range(n):
            step = k + (11 if gap and k > 15 else 0)  # whole blocks are missing
            out.append(("c", f"pdu{s}", at(step * W), *map(float, some.normal(size=3))))
    out.append((None, "pdu0", at(0), 1.0, 1.0, 1.0))  # belongs to no series
    return spark.createDataFrame(out, SCHEMA)


def written_out(df, depth, series):
    windows = sequence_windows(df, ["a", "b"], "y", depth, series=series).collect()
    return np.array([[*np.array(r["context"]).ravel(), 1.0, r["target"]] for r in windows])


@pytest.mark.parametrize("depth", [1, 4, 9])
def test_sums_equal_those_of_windows(spark, monkeypatch, depth):
    monkeypatch.setattr(lagged, "FAN_IN", 2)  # several rounds of adding up
    df = rows(spark).repartition(3)
    z = written_out(df, depth, SMALL)
    assert np.allclose(lagged.lagged_sums(df, ["a", "b"], "y", depth, SMALL), z.T @ z, atol=1e-9)


@pytest.mark.parametrize(("carry", "n"), [(0, 30), (3, 20), (4, 1), (0, 4), (2, 2), (4, 30)])
def test_sums_of_a_block(carry, n):
    some = np.random.default_rng(carry + n)
    every, y = some.normal(size=(carry + n, 3)), some.normal(size=n)
    found = lagged.block_sums(every[carry:], y, every[:carry], 4)
    z = np.array([[*every[t - 4 : t].ravel(), 1.0, y[t - carry]] for t in range(max(4, carry), carry + n)])
    assert found is None if not len(z) else found[0] == len(z) and np.allclose(found[1], np.triu(z.T @ z))


def test_model_equals_sparks(spark):
    df = rows(spark, (60, 50))
    windows = flatten_lags(sequence_windows(df, ["a", "b"], "y", 3, series=SMALL))
    theirs = LinearRegression(featuresCol="features", labelCol="target", solver="normal", regParam=1e-6).fit(windows)
    ours = lagged.fit_lagged(df, ["a", "b"], "y", 3, series=SMALL)
    assert np.allclose(np.ravel(ours.weights), theirs.coefficients.toArray(), atol=1e-4)
    assert abs(ours.bias - theirs.intercept) < 1e-4
    want = {(r.cell, r.pdu, r.window_start): r.prediction for r in theirs.transform(windows).collect()}
    scored = ours.score(df, [F.col("a"), F.col("b")], SMALL)
    got = {(r.cell, r.pdu, r.window_start): r.prediction for r in scored.collect()}
    assert scored.columns == [*df.columns, "prediction"] and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)
    of_windows = windows.select(ours.of_vector("features").alias("p"), "cell", "pdu", "window_start").collect()
    assert all(abs(got[r.cell, r.pdu, r.window_start] - r.p) < 1e-9 for r in of_windows)


def test_constant_columns_and_targets(spark):
    df = rows(spark, (30,)).withColumn("a", F.lit(2.0))
    model = lagged.fit_lagged(df, ["a", "b"], "y", 2)
    assert [w[0] for w in model.weights] == [0.0, 0.0] and any(w[1] for w in model.weights)
    flat = lagged.fit_lagged(df.withColumn("y", F.lit(5.0)), ["a", "b"], "y", 2)
    assert flat.bias == 5.0 and not np.any(flat.weights)


def test_what_cannot_be_fitted(spark):
    with pytest.raises(ValueError, match="longer than the context"):
        lagged.fit_lagged(rows(spark, (3,)), ["a", "b"], "y", 3)
    with pytest.raises(ValueError, match="missing or not a number"):
        lagged.fit_lagged(rows(spark).withColumn("b", F.when(F.col("b") > 0, F.col("b"))), ["a", "b"], "y", 3)


def test_training_builds_no_windows(spark):
    spec = forecast.SequenceSpec(features=("a", "b"), label="y", context_length=3, target_mode="absolute", series=SMALL)
    df = rows(spark, (40, 30))
    fitted = forecast.fit_sequence_regressor(df, spec)
    plan = fitted.predict(df)._jdf.queryExecution().toString()
    assert isinstance(fitted.model, lagged.LagModel) and "flatten" not in plan and "array_to_vector" not in plan
