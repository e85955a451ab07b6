"""Linear models whose loss is quadratic: one pass of moments, then a small solve on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, dot, doubles
from ..model import Model, scorer
from ..stats import Moments, moments, order_statistic


@scorer("linear_regression", "ridge_regression", "lasso_regression", "elastic_net", "robust")
def _linear(state: dict, x: list[Column]) -> Column:
    return dot(state["coefficients"], x, state["intercept"])


def powers(x: list[Column], degree: int) -> list[Column]:
    return [F.pow(c, F.lit(float(k))) if k > 1 else c for c in x for k in range(1, degree + 1)]


@scorer("polynomial_regression")
def _polynomial(state: dict, x: list[Column]) -> Column:
    return dot(state["coefficients"], powers(x, state["degree"]), state["intercept"])


def solve(m: Moments, penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """Least squares about the means; the penalty adds to the features' sums of squares, not to the intercept."""
    d = len(m.mean) - 1
    a = m.cov[:d, :d] * m.n + penalty * np.eye(d)
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    if (np.diag(a) <= 0).any() or np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
        raise ValueError("singular: features are constant or linearly dependent")
    beta = np.linalg.solve(a, m.cov[:d, d] * m.n)
    return beta, float(m.mean[d] - beta @ m.mean[:d])


def _quality(model: Model, m: Moments, beta: np.ndarray) -> Model:
    d = len(beta)
    model.n_samples = int(m.n)
    model.mse = float(max(m.cov[d, d] - 2 * beta @ m.cov[:d, d] + beta @ m.cov[:d, :d] @ beta, 0.0))
    model.r_squared = float(1 - model.mse / m.cov[d, d]) if m.cov[d, d] * m.n > 1e-10 else None
    return model


def linear(df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.0) -> Model:
    """Ordinary least squares, or ridge regression with a penalty."""
    m = moments(checked(df, features, label), doubles([*features, label]))
    beta, b = solve(m, penalty)
    return _quality(Model("ridge_regression" if penalty else "linear_regression", list(features), {"coefficients": beta.tolist(), "intercept": b}), m, beta)


def polynomial(df: DataFrame, features: Sequence[str], label: str, degree: int = 2, penalty: float = 0.0) -> Model:
    """Powers of each feature up to `degree`, without products."""
    if degree < 1:
        raise ValueError("degree must be 1 or more")
    x = powers(doubles(features), degree)
    m = moments(checked(df, features, label), [*x, F.col(label).cast("double")])
    # powers are badly scaled: solve in units of their deviations
    s = np.sqrt(np.maximum(np.diag(m.cov), 1e-300))
    scaled = Moments(m.n, m.mean / s, m.cov / np.outer(s, s))
    beta, b = solve(scaled) if not penalty else (None, None)
    if penalty:
        beta, b = solve(m, penalty)
    else:
        beta, b = beta * s[-1] / s[:-1], float(b * s[-1])
    return _quality(Model("polynomial_regression", list(features), {"coefficients": beta.tolist(), "intercept": b, "degree": degree}), m, beta)


def _descent(cov: np.ndarray, xy: np.ndarray, l1: float, l2: float, rounds: int, tol: float) -> np.ndarray:
    """Cyclic coordinate descent on (1/2) b'Cb - b'c + l1 |b| + (l2 / 2) b'b."""
    beta = np.zeros(len(xy))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(beta)):
            rho = xy[j] - cov[j] @ beta + cov[j, j] * beta[j]
            down = cov[j, j] + l2
            new = np.sign(rho) * max(abs(rho) - l1, 0) / down if down > 1e-12 else 0.0
            most = max(most, abs(new - beta[j]))
            beta[j] = new
        if most < tol:
            break
    return beta


def lasso(df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.1, rounds: int = 1000, tol: float = 1e-10) -> Model:
    """L1 penalty on features in units of their deviations."""
    m = moments(checked(df, features, label), doubles([*features, label]))
    d = len(features)
    s = np.sqrt(np.diag(m.cov)[:d])
    s = np.where(s < 1e-10, 1.0, s)
    beta = _descent(m.cov[:d, :d] / np.outer(s, s), m.cov[:d, d] / s, penalty, 0.0, rounds, tol) / s
    state = {"coefficients": beta.tolist(), "intercept": float(m.mean[d] - beta @ m.mean[:d])}
    return _quality(Model("lasso_regression", list(features), state), m, beta)


def elastic_net(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, l1_ratio: float = 0.5, rounds: int = 1000) -> Model:
    """L1 and L2 penalties on centred features in their own units."""
    if alpha < 0 or not 0 <= l1_ratio <= 1:
        raise ValueError("alpha must be 0 or more and l1_ratio from 0 to 1")
    m = moments(checked(df, features, label), doubles([*features, label]))
    d = len(features)
    beta = _descent(m.cov[:d, :d], m.cov[:d, d], alpha * l1_ratio, alpha * (1 - l1_ratio), rounds, 1e-10)
    state = {"coefficients": beta.tolist(), "intercept": float(m.mean[d] - beta @ m.mean[:d])}
    return _quality(Model("elastic_net", list(features), state), m, beta)


def robust(df: DataFrame, features: Sequence[str], label: str, c: float = 1.345, rounds: int = 50) -> Model:
    """Huber regression by reweighted least squares; the scale is the upper median of absolute deviations."""
    if c <= 0:
        raise ValueError("c must be positive")
    df = checked(df, features, label)
    x, y = doubles(features), F.col(label).cast("double")
    m = moments(df, [*x, y])
    beta, b = solve(m)
    n = int(m.n)
    for _ in range(rounds):
        residual = y - dot(beta, x, b)
        middle = order_statistic(df, residual, n // 2)
        scale = max(1.4826 * order_statistic(df, F.abs(residual - F.lit(middle)), n // 2), 1e-9)
        u = F.abs(residual / F.lit(scale))
        new, nb = solve(moments(df, [*x, y], F.when(u <= c, 1.0).otherwise(F.lit(c) / u)))
        step = float(np.sqrt(((new - beta) ** 2).sum() + (nb - b) ** 2))
        beta, b = new, nb
        if step < 1e-8:
            break
    return _quality(Model("robust", list(features), {"coefficients": beta.tolist(), "intercept": b}), m, beta)
