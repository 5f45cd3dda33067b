"""Fitting the chain field: expected moves are the field's own, the sample is bounded before its features are made."""

import math

import numpy as np

from gridlapse.llm import crf


def test_weighted_pairs_equal_enumeration():
    some = np.random.default_rng(2)
    score, moves = some.normal(size=9), 2 * some.normal(size=(2, 2))
    starts, sizes = np.array([0, 4, 5]), np.array([4, 1, 4])
    weight = np.repeat([0.5, 3.0, 2.0], sizes)
    _, pairs = crf.marginals(score, moves, starts, sizes, weight)
    expected = np.zeros((2, 2))
    for s, n in zip(starts, sizes):
        paths = [[code >> k & 1 for k in range(n)] for code in range(2**n)]
        weights = [math.exp(sum(score[s + k] * p[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths]
        for p, w in zip(paths, weights):
            for a, b in zip(p, p[1:]):
                expected[a, b] += weight[s] * w / sum(weights)
    assert np.allclose(pairs, expected)


def test_fit_takes_the_fields_own_pairs(monkeypatch):
    some = np.random.default_rng(4)
    documents = [(some.normal(size=(n, 3)), np.full(n, 20)) for n in (4, 6, 5, 3)]
    good = np.array([True, False, True, False])
    one = crf.fit(documents, good).moves
    whole = crf.marginals
    monkeypatch.setattr(crf, "marginals", lambda *a: (whole(*a)[0], np.zeros((2, 2))))
    assert not np.allclose(one, crf.fit(documents, good).moves)
