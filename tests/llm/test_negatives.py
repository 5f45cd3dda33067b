"""Hard negatives against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlapse.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, best string, size int"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "b", 1) for r in rows], SCHEMA)


def clusters(n=220, width=6):
    some = random.Random(4)
    centers = [[some.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    rows = []
    for i in range(n):
        label = some.randrange(5)
        rows.append((i, [c + some.gauss(0, 0.4) for c in centers[label + some.randrange(3)]], label))
    return rows


def odd_vectors():
    same = [0.5, 0.25, -0.125, 0.0, 1.0, 2.0]
    return [
        (None, same, 1),
        (10, None, 1),
        (20, same, None),
        (30, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
        (31, [1.0, NAN, 0.0, 0.0, 0.0, 0.0], 1),
        (32, [1.0, INF, 0.0, 0.0, 0.0, 0.0], 1),
        (33, [3e30] * 6, 1),
        (40, [], 2),
        (50, [0.5], 2),
        (-10, same, 3),
        (-10, same, 3),
        (-10, [0.5, 0.2, 0.1, 0.0, 1.0, 1.9], 4),
        *[(1000 + i, same, 2) for i in range(40)],
    ]


def plain(rows, every, rule):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        x = [int(np.floor(float(np.float32(v)) * 256)) for v in vector]
        if sum(v * v for v in x) < negatives.LONGEST:
            kept.append((vec_id, x + [0] * (6 - len(x)), label))
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), vec_id, b) for b, (vec_id, y, _) in enumerate(kept) if b != a]
        good = sorted(s for s in scored if kept[s[2]][2] == label)[: rule.positives]
        others = sorted(s for s in scored if kept[s[2]][2] != label)
        for top, positive, _ in good:
            inside = [s for s in others if -rule.low * top <= -100 * s[0] <= -rule.high * top]
            out += [(anchor, positive, k, s[1], -top, -s[0]) for k, s in enumerate(inside[: rule.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("rule", [negatives.Rule(), negatives.Rule(positives=3, negatives=7, low=20, high=100)])
def test_negatives_of_small_slices(spark, monkeypatch, rule):
    for name, size in (("SLICE", 64), ("GROUP", 8), ("STEP", 16)):
        monkeypatch.setattr(negatives, name, size)
    rows = clusters() + odd_vectors()
    found = negatives.mine(negatives.scaled(frame(spark, rows).repartition(3)), lambda i: F.pmod(i, F.lit(10)) == 0, rule)
    assert sorted(map(tuple, found.collect())) == plain(rows, 10, rule)
    assert len(plain(rows, 10, rule)) > 100


def test_one_slice_and_one_group(spark):
    rows = clusters(120)
    found = negatives.mine(negatives.scaled(frame(spark, rows)), lambda i: F.pmod(i, F.lit(10)) == 0)
    assert sorted(map(tuple, found.collect())) == plain(rows, 10, negatives.Rule())


def test_nothing_to_mine(spark):
    def mined(rows):
        return negatives.mine(negatives.scaled(frame(spark, rows)), lambda i: F.pmod(i, F.lit(10)) == 0).count()

    assert mined([]) == 0
    assert mined([(1, [1.0], 1), (2, [1.0], 2)]) == 0  # no anchor
    assert mined([(10, [1.0], 1), (2, [1.0], 2)]) == 0  # no positive
    assert mined([(10, [1.0], 1), (20, [-1.0], 1), (3, [-0.7], 2)]) == 0  # no window below a negative score


def test_bounds_hold_and_save_scores():
    some = np.random.default_rng(1)
    centers = some.normal(0, 200, (6, 16))
    anchors = np.floor(np.repeat(centers, 20, axis=0) + some.normal(0, 6, (120, 16))).astype(np.int64)
    rows = np.floor(np.repeat(centers, 100, axis=0) + some.normal(0, 6, (600, 16))).astype(np.int64)
    tree = negatives.Tree(anchors, negatives.spanning_tree(anchors))
    whole = anchors @ rows.T
    at = np.quantile(whole, 0.97)
    anchor, row, score = tree.scores(rows, lambda level, low, high: high >= at)
    got = set(zip(anchor.tolist(), row.tolist()))
    assert {tuple(map(int, x)) for x in np.argwhere(whole >= at)} == got
    assert (whole[anchor, row] == score).all()
    assert tree.rescored < whole.size / 2


def test_scores_beyond_doubles_are_exact():
    big = np.array([[1 << 27, 3], [(1 << 27) - 1, 5]], dtype=np.int64)
    tree = negatives.Tree(big, negatives.spanning_tree(big))
    anchor, row, score = tree.scores(big, lambda level, low, high: high >= -np.inf)
    assert {(a, r): s for a, r, s in zip(anchor, row, score)} == {(a, r): int(big[a] @ big[r]) for a in (0, 1) for r in (0, 1)}


def test_spanning_tree_is_minimal():
    points = np.array([[0], [10], [1], [11], [2]], dtype=np.int64)
    parent = negatives.spanning_tree(points)
    assert sum(abs(points[i, 0] - points[p, 0]) for i, p in enumerate(parent)) == 11
    assert [sorted(level.tolist()) for level in negatives.levels(parent)] == [[0], [2], [4], [1], [3]]
    assert negatives.matrix(pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int32()))])).tolist() == [[1, 2], [0, 0], [3, 0]]
