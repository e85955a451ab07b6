"""A neural network of one hidden layer for regression.

Steps are either of the whole table, each gradient summed in one aggregation, or of small batches: then parts of the rows
are trained side by side, batch after batch, and their weights averaged after every pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, dot, doubles
from ..model import Model, scorer
from ..plans.graph import cut


@scorer("mlp_regressor")
def _mlp(state: dict, x: list[Column]) -> Column:
    x = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x, state["mean"], state["scale"], strict=True)]
    hidden = [F.greatest(dot(w, x, b), F.lit(0.0)) for w, b in zip(state["w1"], state["b1"], strict=True)]
    return dot(state["w2"], hidden, state["b2"])


def _unpacked(p: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    sizes = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
    return [p[a:b].reshape(s) for a, b, s in zip(sizes[:-1], sizes[1:], shapes, strict=True)]


def _slopes(p: np.ndarray, shapes: list[tuple[int, ...]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of half the sum of squared errors."""
    w1, b1, w2, b2 = _unpacked(p, shapes)
    a = x @ w1.T + b1
    h = np.maximum(a, 0)
    e = h @ w2 + b2 - y
    back = e[:, None] * w2 * (a > 0)
    return np.concatenate([(back.T @ x).ravel(), back.sum(0), h.T @ e, [e.sum()]])


def _by_steps(df: DataFrame, names: list[str], mean: np.ndarray, scale: np.ndarray, p: np.ndarray, shapes: list, n: int, rate: float, steps: int) -> np.ndarray:
    """Adam on the whole table's gradient."""
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):

        def run(batches: Iterator[pd.DataFrame], p=p) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(p))
            for batch in batches:
                z = (batch[names].to_numpy("f8") - mean) / scale
                total += _slopes(p, shapes, z[:, :-1], z[:, -1])
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        g = np.zeros(len(p))
        for row in df.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            g[row["k"]] = row["v"] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return p


def _by_batches(df: DataFrame, names: list[str], mean: np.ndarray, scale: np.ndarray, p: np.ndarray, shapes: list, n: int, rate: float, passes: int, batch: int, momentum: float, seed: int, rows: int) -> np.ndarray:
    """Momentum on batches within parts of about `rows` rows; after a pass weights and momenta are averaged by rows.

    Draws place the rows, copies apart from each other; they are kept, so that every pass and every retry sees the same
    parts. A task holds one batch of rows from Spark at a time. Averages are sums of decimals, which have no order.
    """
    parts = max(1, -(-n // rows))
    dealt = cut(df.select("*", F.rand(seed).alias("_r")))
    dealt = cut(dealt.repartition(parts, F.floor(F.col("_r") * parts)).sortWithinPartitions("_r", *names))
    q = np.concatenate([p, np.zeros_like(p)])
    for turn in range(passes):

        def run(batches: Iterator[pd.DataFrame], q=q, turn=turn) -> Iterator[pd.DataFrame]:
            now, speed = np.array_split(q, 2)
            seen = 0
            for k, some in enumerate(batches):
                z = ((some[names].to_numpy("f8") - mean) / scale)[np.random.default_rng([seed, turn, k]).permutation(len(some))]
                for low in range(0, len(z), batch):
                    x, y = z[low : low + batch, :-1], z[low : low + batch, -1]
                    speed = momentum * speed - rate * _slopes(now, shapes, x, y) / len(y)
                    now = now + speed
                seen += len(z)
            if not np.isfinite(now).all() or np.abs(now).max() > 1e9:
                raise ValueError("training diverges; lower the rate")
            if seen:
                yield pd.DataFrame({"k": np.arange(len(q)), "v": np.concatenate([now, speed]) * (seen / n)})

        found = dealt.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,20)")).cast("double").alias("v")).collect()
        q = np.zeros_like(q)
        for row in found:
            q[row["k"]] = row["v"]
    return np.array_split(q, 2)[0]


def mlp_regressor(df: DataFrame, features: Sequence[str], label: str, hidden: int = 8, rate: float = 0.05, steps: int = 200, seed: int = 42, batch: int | None = None, momentum: float = 0.9, rows: int = 100_000) -> Model:
    """Rectified hidden units and a linear output, trained on features and label in units of their deviations.

    Steps follow Adam on the whole table's gradient. With `batch`, they are passes of batches of that many rows with
    momentum, in parts of about `rows` rows side by side. Only weights and gradients, of fixed size, leave the tasks.
    """
    if batch is not None and batch < 1:
        raise ValueError("batch must be 1 or more")
    df = checked(df, features, label).select(*[x.alias(n) for x, n in zip(doubles(features), features, strict=True)], F.col(label).cast("double").alias("_y")).cache()
    try:
        d = len(features)
        names = [*features, "_y"]
        r = df.agg(F.count(F.lit(1)), *[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
        n = r[0]
        if not n:
            raise ValueError("no rows to train on")
        mean, scale = np.array(r[1 : d + 2]), np.array([s or 1.0 for s in r[d + 2 :]])
        rng = np.random.default_rng(seed)
        shapes = [(hidden, d), (hidden,), (hidden,), (1,)]
        p = np.concatenate([rng.uniform(-1, 1, hidden * d) * np.sqrt(2 / d), np.zeros(hidden), rng.uniform(-1, 1, hidden) * np.sqrt(2 / hidden), [0.0]])
        if batch is None:
            p = _by_steps(df, names, mean, scale, p, shapes, n, rate, steps)
        else:
            p = _by_batches(df, names, mean, scale, p, shapes, n, rate, steps, batch, momentum, seed, rows)
        w1, b1, w2, b2 = _unpacked(p, shapes)
        sy, my = scale[-1], mean[-1]
        state = {"mean": mean[:-1].tolist(), "scale": scale[:-1].tolist(), "w1": w1.tolist(), "b1": b1.tolist(), "w2": (w2 * sy).tolist(), "b2": float(b2[0] * sy + my)}
        model = Model("mlp_regressor", list(features), state, n_samples=n)
        q = model.column()
        out = df.agg(F.avg((F.col("_y") - q) * (F.col("_y") - q)), F.var_pop("_y")).first()
        model.mse, model.r_squared = out[0], 1 - out[0] / out[1] if out[1] else None
        return model
    finally:
        df.unpersist()
