from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlapse.operators import baselines, evaluate, features, forecast
from gridlapse.schema import BASELINE_FEATURES, METRICS
from tests import frames

LABEL = "measured_power_util"


def predictions(spark, pairs, **constants):
    df = spark.createDataFrame([(float(y), float(p)) for y, p in pairs], "y double, prediction double")
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def numpy_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    total = ((y - y.mean()) ** 2).sum()
    return {
        "mae": np.abs(y - p).mean(),
        "rmse": np.sqrt(((y - p) ** 2).mean()),
        "mape": np.abs((y - p) / np.maximum(np.abs(y), 1e-8)).mean(),
        "smape": (2 * np.abs(p - y) / np.maximum(np.abs(y) + np.abs(p), 1e-8)).mean(),
        "r2": 0.0 if total <= 1e-8 else 1 - ((y - p) ** 2).sum() / total,
    }


@pytest.mark.parametrize(
    "pairs",
    [
        [(1, 1.5), (2, 1.0), (4, 4.5), (0, 0.0)],
        [(3, 1), (3, 5)],
        [(0, 1e-9), (0, 2.0)],
        [(1e6 + i, 1e6 + i * 1.01) for i in range(50)],
    ],
)
def test_metrics_match_their_formulas(spark, pairs):
    row = evaluate.regression_metrics(predictions(spark, pairs, model="m"), ["model"]).first()
    expected = numpy_metrics(*zip(*pairs))
    for name in METRICS:
        assert row[name] == pytest.approx(expected[name], rel=1e-9, abs=1e-12)
    assert row["sample_count"] == len(pairs)


def dataset(spark, pdus=3, length=120):
    return features.chronological_split(features.build_features(frames.wavy(spark, pdus, length)))


def collected(df, columns):
    rows = df.orderBy("pdu", "window_start").collect()
    return np.array([[float(r[c]) for c in columns] for r in rows])


def test_simple_baselines(spark):
    df = spark.createDataFrame([(0.6, 400.0)], "prev_measured_power_util double, prev_total_cpu_usage double")
    assert df.select(baselines.persistence()).first()[0] == 0.6
    assert df.select(baselines.moving_average()).first()[0] == pytest.approx(200.3)


def test_cpu_line_is_least_squares(spark):
    data = dataset(spark)
    line = baselines.cpu_line(data, LABEL).first()
    xy = collected(data, ["total_cpu_usage", LABEL])
    weight, bias = np.polyfit(xy[:, 0], xy[:, 1], 1)
    assert (line["bias"], line["weight"]) == pytest.approx((bias, weight))
    flat = baselines.cpu_line(data.withColumn("total_cpu_usage", F.lit(3.0)), LABEL).first()
    design = np.stack([np.ones(len(xy)), np.full(len(xy), 3.0)], axis=1)
    expected = np.linalg.lstsq(design, xy[:, 1], rcond=None)[0]
    assert (flat["bias"], flat["weight"]) == pytest.approx(tuple(expected))


def closed_form(x, y, alpha):
    centred = x - x.mean(axis=0)
    gram = centred.T @ centred + alpha * np.eye(x.shape[1])
    weights = np.linalg.lstsq(gram, centred.T @ (y - y.mean()), rcond=None)[0]
    return y.mean() + centred @ weights


@pytest.mark.parametrize(("name", "alpha"), [("linear_regression", 0.0), ("ridge", 1.0)])
def test_linear_models_match_the_closed_form(spark, name, alpha):
    data = dataset(spark)
    columns = list(BASELINE_FEATURES[name])
    model = baselines.fit_baseline(name, data, LABEL)
    assert "machine_count" not in model.features
    got = collected(model.predict(data), ["prediction"])[:, 0]
    values = collected(data, [*columns, LABEL])
    assert got == pytest.approx(closed_form(values[:, :-1], values[:, -1], alpha), abs=1e-7)


def test_forest_is_repeatable_and_better_than_the_mean(spark):
    data = dataset(spark)
    train = data.where("split = 'train'")
    one, two = (baselines.fit_baseline("random_forest", train, LABEL, 7, trees=10) for _ in range(2))
    first = collected(one.predict(data), ["prediction"])
    assert (first == collected(two.predict(data), ["prediction"])).all()
    scored = baselines.predict_all([one], train, LABEL)
    assert evaluate.regression_metrics(scored, ["model"]).first()["r2"] > 0.8
    with pytest.raises(ValueError, match="No baseline"):
        baselines.fit_baseline("other", train, LABEL)


def test_fit_and_score_with_a_holdout(spark):
    data = dataset(spark)
    holdout = features.build_features(frames.wavy(spark, 1, 60).withColumn("pdu", F.lit("unseen")))
    metrics = baselines.fit_and_score(data, LABEL, holdout=holdout, trees=5)
    rows = metrics.collect()
    assert len(rows) == 6 * 3
    assert {r["split"] for r in rows} == {"val", "test", "holdout"}
    table = baselines.holdout_benchmark(metrics).collect()
    errors = [r["holdout_mae"] for r in table]
    assert len(table) == 6 and errors == sorted(errors)
    assert table[-1]["model"] == "moving_average" and errors[-1] > 100
    subset = baselines.fit_and_score(data, LABEL, models=["persistence"])
    assert baselines.baseline_benchmark(subset).count() == 1


def runs(spark, rows):
    schema = "family string, model string, seed long, split string, mae double, rmse double, r2 double"
    return spark.createDataFrame(rows, schema)


def test_repeated_run_summary_uses_the_population_deviation(spark):
    df = runs(spark, [("deep", "m", s, "test", float(v), float(v), float(v)) for s, v in ((42, 1), (7, 2), (21, 3))])
    row = evaluate.run_summary(df).first()
    assert row["runs"] == 3 and row["mae_mean"] == 2.0
    assert row["mae_std"] == pytest.approx(0.816497, abs=1e-6)


def test_a_tie_is_not_a_win_and_lone_seeds_are_skipped(spark):
    deep = runs(spark, [("deep", "d", 1, "holdout", 1.0, 1.0, 0.5), ("deep", "d", 2, "holdout", 1.0, 3.0, 0.9), ("deep", "d", 3, "holdout", 0.0, 0.0, 1.0)])
    base = runs(spark, [("baseline", "b", 1, "holdout", 1.0, 2.0, 0.5), ("baseline", "b", 2, "holdout", 2.0, 2.0, 0.1)])
    row = evaluate.winner_counts(deep, base).first()
    assert (row["mae_wins"], row["rmse_wins"], row["r2_wins"], row["seeds"]) == (1, 1, 1, 2)
    assert evaluate.runs_by_seed(deep, base, "left").count() == 3


def test_comparison_order_gaps_and_missing_columns(spark):
    columns = "model string, test_mae double, test_rmse double, test_r2 double"
    base = spark.createDataFrame([("rf", 0.2, 0.3, 0.9), ("ridge", 0.2, 0.4, 0.8)], columns)
    deep = spark.createDataFrame([("lstm", 0.1, 0.5, 0.7, 12)], columns + ", context_length int")
    table = evaluate.compare_models(base, deep)
    assert [r["model"] for r in table.collect()] == ["lstm", "rf", "ridge"]
    assert [r["context_length"] for r in table.collect()] == [12, None, None]
    assert {r["model"] for r in evaluate.best_per_family(table).collect()} == {"lstm", "rf"}
    gap = evaluate.best_gap(table, "deep").first()
    assert gap["test_mae_gap"] == pytest.approx(-0.1) and gap["test_r2_gap"] == pytest.approx(-0.2)


def test_ensemble_mean_and_truth_check(spark):
    members = predictions(spark, [(2, 1)], k=1).unionByName(predictions(spark, [(2, 3)], k=1))
    row = evaluate.ensemble_mean(members, ["k"]).first()
    assert (row["y"], row["prediction"], row["member_count"]) == (2.0, 2.0, 2)
    differing = predictions(spark, [(2, 1)], k=1).unionByName(predictions(spark, [(2.1, 3)], k=1))
    with pytest.raises(Exception, match="disagree on the true value"):
        evaluate.ensemble_mean(differing, ["k"]).collect()
    close = predictions(spark, [(2, 1)], k=1).unionByName(predictions(spark, [(2.000001, 3)], k=1))
    assert evaluate.ensemble_mean(close, ["k"]).count() == 1


SPEC = forecast.SequenceSpec(features=("total_cpu_usage", "prev_measured_power_util"), context_length=6)


@pytest.mark.parametrize("mode", ["residual", "absolute"])
def test_sequence_regressor_data_path(spark, tmp_path, mode):
    data = dataset(spark)
    train = data.where("split = 'train'").drop("split")
    spec = forecast.SequenceSpec(features=SPEC.features, context_length=6, target_mode=mode)
    fitted = forecast.fit_sequence_regressor(train, spec)
    scored = forecast.score_splits(fitted, data)
    assert {r["split"]: r["count"] for r in scored.groupBy("split").count().collect()} == {"val": 54, "test": 54}
    val = data.where("split = 'val'").drop("split")
    apart = fitted.predict(val, train)
    together = scored.where("split = 'val'").drop("split")
    assert apart.exceptAll(together).count() == 0
    truth = scored.join(data.select("cell", "pdu", "window_start", LABEL), ["cell", "pdu", "window_start"])
    assert truth.where(F.abs(F.col("y") - F.col(LABEL)) > 1e-9).count() == 0
    assert evaluate.regression_metrics(scored, ["split"]).where("mae > 0.05").count() == 0

    path = str(tmp_path / "model")
    fitted.save(path)
    loaded = forecast.SequenceRegressor.load(spark, path)
    assert loaded.spec == spec and loaded.standardizer == fitted.standardizer
    unseen = features.build_features(frames.wavy(spark, 2, 40))
    first, second = (forecast.score_holdout(m, unseen).first() for m in (fitted, loaded))
    assert first == second and first["sample_count"] == 2 * 34


@pytest.mark.parametrize("learner", ["gbt", "forest"])
def test_tree_learners_depend_on_the_seed_only(spark, tmp_path, learner):
    data = dataset(spark, 2, 60)
    train = data.where("split = 'train'").drop("split")
    spec = forecast.SequenceSpec(features=SPEC.features, context_length=4, learner=learner)
    unseen = features.build_features(frames.wavy(spark, 1, 30))
    one, same, other = (
        forecast.fit_sequence_regressor(train, spec, seed) for seed in (1, 1, 2)
    )
    scores = [forecast.score_holdout(m, unseen).first() for m in (one, same, other)]
    assert scores[0] == scores[1] != scores[2]
    path = str(tmp_path / "model")
    one.save(path)
    assert forecast.score_holdout(forecast.SequenceRegressor.load(spark, path), unseen).first() == scores[0]


def test_sequence_spec_refuses_unknown_settings():
    for bad in ({"target_mode": "x"}, {"target_scaling": "x"}, {"learner": "x"}):
        with pytest.raises(ValueError, match="named"):
            forecast.SequenceSpec(**bad)


def test_ensemble_report_of_sequence_members(spark):
    data = dataset(spark, 2, 80)
    train = data.where("split = 'train'").drop("split")
    both = None
    for i, scaling in enumerate(("standard", "none")):
        spec = forecast.SequenceSpec(features=SPEC.features, context_length=6, target_scaling=scaling)
        scored = forecast.score_splits(forecast.fit_sequence_regressor(train, spec), data)
        scored = scored.withColumns({"model": F.lit(scaling), "seed": F.lit(i)})
        both = scored if both is None else both.unionByName(scored)
    members, mean, combined = forecast.ensemble_report(both, ["cell", "pdu", "window_start"])
    assert members.count() == 4 and mean.count() == 2
    assert all(r["sample_count"] == 24 for r in combined.collect())


def test_seed_stability_and_resuming(spark):
    data = dataset(spark, 2, 80)
    holdout = features.build_features(frames.wavy(spark, 1, 50))
    with pytest.raises(ValueError, match="every seed"):
        forecast.seed_stability(data, holdout, SPEC, seeds=(42, 7), trees=3)
    seeded = replace(SPEC, learner="forest")
    report = forecast.seed_stability(data, holdout, seeded, seeds=(42, 7), trees=3)
    assert report.metrics.count() == 2 * (3 + 3)
    assert [r["seed"] for r in report.per_seed.collect()] == [7, 42]
    assert report.summary.count() == 4
    assert report.winners.first()["seeds"] == 2
    again = forecast.seed_stability(data, holdout, seeded, seeds=(42, 7, 21), trees=3, done=report.metrics)
    assert again.per_seed.count() == 3
    assert report.metrics.exceptAll(again.metrics).count() == 0


def test_a_failed_seed_leaves_the_others_finished(spark, tmp_path, monkeypatch):
    data, holdout = dataset(spark, 2, 60), features.build_features(frames.wavy(spark, 1, 40))
    spec, where = replace(SPEC, learner="forest", context_length=4), str(tmp_path / "seeds")
    real, fitted = forecast._learner, []

    def learner(spec, seed):
        fitted.append(seed)
        if seed == 21 and fitted.count(21) == 1:
            raise ValueError("lost")
        return real(spec, seed)

    monkeypatch.setattr(forecast, "_learner", learner)
    options = {"seeds": (42, 7, 21), "trees": 3, "store": where, "parallel": 3}
    with pytest.raises(RuntimeError, match=r"Seeds \[21\] failed"):
        forecast.seed_stability(data, holdout, spec, **options)
    report = forecast.seed_stability(data, holdout, spec, **options)
    assert sorted(fitted) == [7, 21, 21, 42]
    assert report.metrics.count() == 3 * (3 + 3) and report.winners.first()["seeds"] == 3
    alone = forecast.seed_stability(data, holdout, spec, seeds=(42, 7, 21), trees=3, parallel=1)
    assert sorted(map(tuple, alone.metrics.collect())) == sorted(map(tuple, report.metrics.collect()))


def test_ensemble_refuses_a_member_twice(spark):
    rows = [("deep", "m", s, k, 1.0, float(s)) for k in (1, 2) for s in (7, 42)]
    schema = "family string, model string, seed long, k int, y double, prediction double"
    assert evaluate.ensemble_mean(spark.createDataFrame(rows, schema), ["k"]).count() == 2
    twice = [*rows[:3], ("deep", "m", 7, 2, 1.0, 7.0)]  # key 2 has seed 7 twice and lacks 42
    with pytest.raises(Exception, match="lacks an ensemble member"):
        evaluate.ensemble_mean(spark.createDataFrame(twice, schema), ["k"]).collect()
    plan = evaluate.ensemble_mean(spark.createDataFrame(rows, schema), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
