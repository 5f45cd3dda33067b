import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridlapse.operators import features, sequence
from gridlapse.plans.blocks import Series
from tests import frames
from tests.frames import W

LABEL = "measured_power_util"
SMALL_BLOCKS = Series(block_us=5 * W)
FEATURES = ["total_cpu_usage", "avg_cpu_usage"]


def windows_by_hand(df, columns, depth):
    """Expected windows from collected rows; for fixtures only."""
    rows = df.orderBy("pdu", "window_start").collect()
    out = {}
    for pdu in sorted({r["pdu"] for r in rows}):
        part = [r for r in rows if r["pdu"] == pdu]
        for i in range(depth, len(part)):
            out[(pdu, part[i]["window_start"])] = (
                [[float(r[c]) for c in columns] for r in part[i - depth : i]],
                part[i][LABEL],
            )
    return out


@pytest.mark.parametrize("series", [Series(), SMALL_BLOCKS, Series(block_us=W)])
@pytest.mark.parametrize("step", [1, 3])
def test_context_is_the_rows_before_the_target(spark, series, step):
    data = frames.series(spark, [(p, i * step, 0.1 * i, i) for p in ("pdu1", "pdu2") for i in range(14)])
    windows = sequence.sequence_windows(data, FEATURES, LABEL, 12, series=series)
    got = {(r["pdu"], r["window_start"]): (r["context"], r["target"]) for r in windows.collect()}
    assert got == windows_by_hand(data, FEATURES, 12)
    assert len(got) == 4
    targets = sequence.sequence_targets(data, LABEL, 12, series=series)
    assert {(r["pdu"], r["window_start"]): r[LABEL] for r in targets.collect()} == {
        k: v[1] for k, v in got.items()
    }


def test_history_gives_context_only(spark):
    data = frames.series(spark, [("pdu1", i, 0.1 * i, i) for i in range(15)])
    history = data.where(F.unix_micros("window_start") < 12 * W)
    target = data.where(F.unix_micros("window_start") >= 12 * W)
    rows = sequence.with_history(target, history)
    for series in (Series(), SMALL_BLOCKS):
        windows = sequence.sequence_windows(rows, FEATURES, LABEL, 12, series=series)
        assert windows.count() == 3
        assert sequence.sequence_targets(rows, LABEL, 12, series=series).count() == 3
    assert sequence.sequence_windows(target, FEATURES, LABEL, 12).count() == 0


def test_window_count_per_series(spark):
    data = frames.wavy(spark, 3, 40)
    assert sequence.sequence_windows(data, FEATURES, LABEL, 12).count() == 3 * 28
    assert sequence.sequence_windows(data, FEATURES, LABEL, 50).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        sequence.sequence_windows(data, FEATURES, LABEL, 0)
    with pytest.raises(ValueError, match="lacks sequence columns"):
        sequence.sequence_windows(data, ["nothing"], LABEL, 3)


def test_flattened_lags_keep_order(spark):
    data = frames.series(spark, [("pdu1", i, 0.1 * i, i) for i in range(4)])
    flat = sequence.flatten_lags(sequence.sequence_windows(data, FEATURES, LABEL, 3))
    vector = flat.select(vector_to_array("features")).first()[0]
    assert vector == [0.0, 0.0, 1.0, 0.25, 2.0, 0.5]


def exploded_statistics(df, columns, depth):
    windows = windows_by_hand(df, columns, depth)
    contexts = np.array([c for c, _ in windows.values()])
    targets = np.array([t for _, t in windows.values()])
    return contexts.mean(axis=(0, 1)), contexts.std(axis=(0, 1)), targets.mean(), targets.std()


@pytest.mark.parametrize(("length", "depth"), [(4, 2), (40, 12), (13, 12), (20, 12), (5, 1)])
@pytest.mark.parametrize("series", [Series(), SMALL_BLOCKS])
def test_standardizer_equals_exploded_windows(spark, length, depth, series):
    data = frames.wavy(spark, 2, length, step=2)
    columns = ["total_cpu_usage", "avg_cpu_usage", "machine_count"]
    fitted = sequence.load_standardizer(
        sequence.fit_standardizer(data, columns, LABEL, depth, series=series)
    )
    mean, std, target_mean, target_std = exploded_statistics(data, columns, depth)
    assert fitted.features == tuple(columns)
    assert fitted.means == pytest.approx(mean)
    assert fitted.stds[:2] == pytest.approx(std[:2])
    assert fitted.stds[2] == 1.0
    assert fitted.target_mean == pytest.approx(target_mean)
    assert fitted.target_std == pytest.approx(target_std)


def test_standardizer_without_windows(spark):
    data = frames.wavy(spark, 2, 5)
    with pytest.raises(ValueError, match="nothing to fit"):
        sequence.load_standardizer(sequence.fit_standardizer(data, FEATURES, LABEL, 12))


def test_scaling_can_be_undone(spark):
    data = frames.wavy(spark, 2, 30)
    fitted = sequence.load_standardizer(sequence.fit_standardizer(data, FEATURES, LABEL, 4))
    assert sequence.Standardizer.from_json(fitted.to_json()) == fitted
    raw = sequence.sequence_windows(data, FEATURES, LABEL, 4)
    scaled = sequence.apply_standardizer(raw, fitted)
    stats = scaled.select(F.avg("target"), F.stddev_pop("target")).first()
    assert stats[0] == pytest.approx(0.0, abs=1e-9) and stats[1] == pytest.approx(1.0)
    back = sequence.invert_targets(scaled, fitted, "target")
    order = ["pdu", "window_start"]
    for a, b in zip(raw.orderBy(order).collect(), back.orderBy(order).collect()):
        assert a["target"] == pytest.approx(b["target"])
    plain = fitted.without_target_scaling()
    unscaled = sequence.apply_standardizer(raw, plain).orderBy(order).first()["target"]
    assert unscaled == raw.orderBy(order).first()["target"]


def test_split_windows_lose_no_rows_at_the_borders(spark):
    """Published arithmetic: only train loses context_length rows per series."""
    data = features.chronological_split(features.build_features(frames.wavy(spark, 5, 100)))
    train = data.where("split = 'train'").drop("split")
    val = data.where("split = 'val'").drop("split")
    assert sequence.sequence_windows(train, FEATURES, LABEL, 12).count() == 350 - 5 * 12
    both = sequence.with_history(val, train)
    assert sequence.sequence_windows(both, FEATURES, LABEL, 12).count() == 75


def test_blocks_are_cut_before_the_shuffle(spark):
    windows = sequence.sequence_windows(frames.wavy(spark, 3, 50), FEATURES, LABEL, 12)
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
