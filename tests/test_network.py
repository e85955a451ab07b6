"""Training of the network in batches."""

import numpy as np
import pytest

from sparkloom.operators import network


def plain(x, y, hidden, rate, steps, seed, momentum):
    """Momentum on all rows at once, in numpy."""
    x, y, d = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std(), x.shape[1]
    rng = np.random.default_rng(seed)
    w1, b1 = (rng.uniform(-1, 1, hidden * d) * np.sqrt(2 / d)).reshape(hidden, d), np.zeros(hidden)
    w2, b2 = rng.uniform(-1, 1, hidden) * np.sqrt(2 / hidden), 0.0
    speed = [0.0] * 4
    for _ in range(steps):
        a = x @ w1.T + b1
        e = np.maximum(a, 0) @ w2 + b2 - y
        back = (e[:, None] * (a > 0)) * w2
        grads = [back.T @ x, back.sum(0), np.maximum(a, 0).T @ e, e.sum()]
        speed = [momentum * s - rate * g / len(y) for s, g in zip(speed, grads, strict=True)]
        w1, b1, w2, b2 = (w + s for w, s in zip((w1, b1, w2, b2), speed, strict=True))
    return w1


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 2))
    y = np.abs(x[:, 0]) + 0.5 * x[:, 1] + 0.05 * rng.normal(size=1200)
    return x, y, spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").coalesce(2)


def test_one_batch_is_momentum_on_all_rows(bent):
    x, y, df = bent
    m = network.mlp_regressor(df, ["a", "b"], "y", hidden=5, rate=0.1, steps=4, batch=5000, momentum=0.8)
    assert np.allclose(m.state["w1"], plain(x, y, 5, 0.1, 4, 42, 0.8))


def test_batches_in_parts_learn_and_repeat(bent):
    _, _, df = bent
    first, again = (network.mlp_regressor(df, ["a", "b"], "y", hidden=12, rate=0.02, steps=8, batch=32, rows=400) for _ in range(2))
    assert first.state == again.state and first.r_squared > 0.9
    with pytest.raises(ValueError, match="batch"):
        network.mlp_regressor(df, ["a", "b"], "y", batch=0)
    with pytest.raises(Exception, match="diverges"):
        network.mlp_regressor(df, ["a", "b"], "y", rate=1e6, steps=2, batch=8)
