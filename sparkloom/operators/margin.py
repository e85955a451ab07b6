"""Support vector machines by full-batch subgradient steps on linear or random Fourier features.

The kernel matrix of an exact solver grows with the square of the rows and lives in one place; here the radial kernel is
stood for by `width` random cosines of the features, whose inner products estimate it, so that an epoch is one
aggregation over rows that stay where they are. Accuracy grows with `width`, not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, dot, doubles
from ..model import Model, scorer


def _mapped(state: dict, x: list[Column]) -> list[Column]:
    x = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x, state["mean"], state["scale"], strict=True)]
    if state["kernel"] == "linear":
        return x
    return [F.cos(dot(w, x, b)) for w, b in zip(state["directions"], state["phases"], strict=True)]


@scorer("svr")
def _svr(state: dict, x: list[Column]) -> Column:
    return dot(state["weights"], _mapped(state, x), state["bias"])


@scorer("svm")
def _svm(state: dict, x: list[Column]) -> Column:
    return (dot(state["weights"], _mapped(state, x), state["bias"]) >= 0).cast("double")


def _fit(df: DataFrame, features: Sequence[str], label: str, kind: str, kernel: str, c: float, epsilon: float, gamma: float, width: int, epochs: int) -> Model:
    if kernel not in ("linear", "rbf"):
        raise ValueError("kernel must be linear or rbf")
    df = checked(df, features, label).select(*[x.alias(n) for x, n in zip(doubles(features), features, strict=True)], F.col(label).cast("double").alias("_y")).cache()
    try:
        d = len(features)
        r = df.agg(F.count(F.lit(1)), F.avg("_y"), *[F.avg(n) for n in features], *[F.stddev_pop(n) for n in features], F.count_if(~F.col("_y").isin(0.0, 1.0))).first()
        n = r[0]
        if not n:
            raise ValueError("no rows to train on")
        if kind == "svm" and r[-1]:
            raise ValueError("labels must be 0 or 1")
        mean, scale = np.array(r[2 : 2 + d]), np.array([s or 1.0 for s in r[2 + d : 2 + 2 * d]])
        rng = np.random.default_rng(42)
        gamma = gamma if gamma > 0 else 1.0 / d
        directions = rng.normal(size=(width, d)) * np.sqrt(2 * gamma)
        phases = rng.uniform(0, 2 * np.pi, width)
        many = d if kernel == "linear" else width
        w, b = np.zeros(many), float(r[1]) if kind == "svr" else 0.0

        def gradient(w: np.ndarray, b: float, smooth: float) -> np.ndarray:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros((many + 1, many + 2))
                for batch in batches:
                    y = batch["_y"].to_numpy()
                    z = (batch[list(features)].to_numpy("f8") - mean) / scale
                    z = z if kernel == "linear" else np.cos(z @ directions.T + phases)
                    z = np.hstack([z, np.ones((len(z), 1))])
                    f = z @ np.append(w, b)
                    if kind == "svr":  # rows outside the tube pull with a weight that makes squares act as absolutes
                        over = np.abs(y - f) - epsilon
                        weight = np.where(over > 0, 1 / np.maximum(np.abs(y - f), smooth), 0)
                        target = y - epsilon * np.sign(y - f)
                    else:
                        y = 2 * y - 1
                        weight = np.where(y * f < 1, 1 / np.maximum(1 - y * f, smooth), 0)
                        target = y
                    total[:, :-1] += (z.T * weight) @ z
                    total[:, -1] += (z.T * weight) @ target
                at = np.arange(total.size)
                yield pd.DataFrame({"k": at, "v": total.ravel()})

            rows = df.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
            out = np.zeros((many + 1) * (many + 2))
            out[[r["k"] for r in rows]] = [r["v"] for r in rows]
            return out.reshape(many + 1, many + 2)

        for _ in range(epochs):
            g = gradient(w, b, 1e-3)
            ridge = np.eye(many + 1) / c
            ridge[-1, -1] = 1e-9
            new = np.linalg.solve(g[:, :-1] + ridge, g[:, -1])
            step = np.abs(new - np.append(w, b)).max()
            w, b = new[:-1], float(new[-1])
            if step < 1e-6:
                break
        state = {"kernel": kernel, "mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "bias": b, "directions": directions.tolist() if kernel == "rbf" else [], "phases": phases.tolist() if kernel == "rbf" else []}
        model = Model(kind, list(features), state, n_samples=n)
        p = model.column()
        q = df.agg(F.avg((F.col("_y") - p) * (F.col("_y") - p)), F.var_pop("_y")).first()
        if kind == "svr":
            model.mse, model.r_squared = q[0], 1 - q[0] / q[1] if q[1] else None
        else:
            model.extra["accuracy"] = 1 - q[0]
        return model
    finally:
        df.unpersist()


def svr(df: DataFrame, features: Sequence[str], label: str, kernel: str = "rbf", c: float = 100.0, epsilon: float = 0.1, gamma: float = 0.0, width: int = 100, epochs: int = 15) -> Model:
    """Regression that ignores errors within epsilon: reweighted least squares, each round one aggregation of a
    (width + 1)^2 matrix; what the driver holds doesn't grow with the rows."""
    return _fit(df, features, label, "svr", kernel, c, epsilon, gamma, width, epochs)


def svm(df: DataFrame, features: Sequence[str], label: str, kernel: str = "rbf", c: float = 10.0, gamma: float = 0.0, width: int = 100, epochs: int = 15) -> Model:
    """Two classes, 0 and 1, by the hinge loss, in the same rounds."""
    return _fit(df, features, label, "svm", kernel, c, 0.0, gamma, width, epochs)
