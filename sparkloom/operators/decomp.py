"""Principal components and linear discriminants from distributed moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, dot, doubles
from ..model import Model, scorer
from ..stats import moments


@scorer("pca", "lda")
def _first_score(state: dict, x: list[Column]) -> Column:
    return scores(state, x)[0]


def scores(state: dict, x: list[Column]) -> list[Column]:
    """All component scores of the centred row."""
    off = [c - F.lit(float(m)) for c, m in zip(x, state["mean"], strict=True)]
    return [dot(v, off) for v in state["vectors"]]


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each vector with its largest entry positive."""
    return np.array([v * (1 if v[np.abs(v).argmax()] >= 0 else -1) for v in vectors])


def pca(df: DataFrame, features: Sequence[str], k: int = 2) -> Model:
    m = moments(checked(df, features), doubles(features))
    values, vectors = np.linalg.eigh(m.cov)
    order = np.argsort(-values)[: min(k, len(features))]
    share = values[order] / max(values.sum(), 1e-300)
    return Model("pca", list(features), {"mean": m.mean.tolist(), "vectors": _signed(vectors.T[order]).tolist(), "variance": values[order].tolist(), "ratio": share.tolist()}, n_samples=int(m.n))


def lda(df: DataFrame, features: Sequence[str], label: str, k: int = 2) -> Model:
    """Linear discriminants: directions that spread class means most against the scatter within classes."""
    df, d = checked(df, features, label), len(features)
    x = doubles(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).orderBy(label).collect()
    if len(rows) < 2:
        raise ValueError("fewer than two classes")
    n = np.array([r["n"] for r in rows], "f8")
    means = np.array([[r[f"m{i}"] for i in range(d)] for r in rows])
    mean = n @ means / n.sum()
    within = np.zeros((d, d))
    for r in rows:
        for i, j in pairs:
            within[i, j] += r["n"] * r[f"c{i}_{j}"]
            within[j, i] = within[i, j]
    between = (means - mean).T @ np.diag(n) @ (means - mean)
    within += 1e-9 * np.trace(within) / d * np.eye(d)
    low = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(low @ between @ low.T)
    order = np.argsort(-values)[: min(k, len(rows) - 1, d)]
    v = (low.T @ vectors[:, order]).T
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return Model("lda", list(features), {"mean": mean.tolist(), "vectors": _signed(v).tolist(), "values": values[order].tolist()}, n_samples=int(n.sum()))
