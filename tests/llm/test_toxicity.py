"""The learner of one shard against FTRL-proximal as it is written down, in dictionaries."""

import math
import random

import numpy as np
import pandas as pd

from argotlog.llm.toxicity import SPACE, Ftrl, _features_of, _learn


def plain(rows, labels, how):
    """{place: (z, n)} after all passes; the last place is the bias, without penalty."""
    state = {}

    def weight(i):
        z, n = state.get(i, (0.0, 0.0))
        l1 = 0.0 if i == SPACE else how.l1
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((how.beta + math.sqrt(n)) / how.alpha + how.l2)

    for _ in range(how.passes):
        for row, label in zip(rows, labels, strict=True):
            places = [*row, SPACE]
            weights = {i: weight(i) for i in places}
            slope = 1 / (1 + math.exp(-sum(weights.values()))) - label
            for i in places:
                z, n = state.get(i, (0.0, 0.0))
                sigma = (math.sqrt(n + slope * slope) - math.sqrt(n)) / how.alpha
                state[i] = (z + slope - sigma * weights[i], n + slope * slope)
    return state


def test_one_shard_equals_the_plain_learner():
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(8)]
    texts = [" ".join(rng.choices(good, k=12) + (rng.choices(bad, k=3) if i % 4 == 0 else [])) for i in range(60)]
    labels = np.array([float(i % 4 == 0) for i in range(60)])
    how = Ftrl(l1=1.0)
    rows = _features_of(pd.Series(texts))
    expected = plain([r.tolist() for r in rows], labels.tolist(), how)
    z, n = np.zeros(SPACE + 1, np.float64), np.zeros(SPACE + 1, np.float64)
    _learn(rows, labels, z, n, how)
    touched = np.flatnonzero(n)
    assert set(touched.tolist()) == {i for i, (_, n_i) in expected.items() if n_i}
    assert np.allclose(z[touched], [expected[i][0] for i in touched], atol=1e-9) and np.allclose(n[touched], [expected[i][1] for i in touched], atol=1e-9)
    heavy = [i for i, (z_i, _) in expected.items() if abs(z_i) > how.l1]
    assert 0 < len(heavy) < len(expected) / 2  # the penalty keeps most weights at zero
