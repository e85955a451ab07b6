"""Models fitted by full-batch gradient steps: an epoch is one aggregation over the (cached) rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, dot, doubles, encode_labels, first_greatest, sigmoid
from ..model import Model, scorer
from ..stats import running_sums


@scorer("logistic_regression")
def _logistic(state: dict, x: list[Column]) -> Column:
    return (sigmoid(dot(state["coefficients"], x, state["intercept"])) >= 0.5).cast("double")


@scorer("multilogistic")
def _multi(state: dict, x: list[Column]) -> Column:
    best = first_greatest([dot(w[:-1], x, w[-1]) for w in state["weights"]])
    return F.element_at(F.array(*[F.lit(float(c)) for c in state["classes"]]), best + 1)


def _cumulative(state: dict, x: list[Column]) -> list[Column]:
    z = dot(state["coefficients"], x)
    below = [sigmoid(F.lit(float(t)) - z) for t in state["thresholds"]]
    return [b - a for a, b in zip([F.lit(0.0), *below], [*below, F.lit(1.0)], strict=True)]


@scorer("ordinal")
def _ordinal(state: dict, x: list[Column]) -> Column:
    return F.element_at(F.array(*[F.lit(float(c)) for c in state["classes"]]), first_greatest(_cumulative(state, x)) + 1)


@scorer("cox")
def _cox(state: dict, x: list[Column]) -> Column:
    return F.exp(dot(state["coefficients"], x))


def _sums(df: DataFrame, columns: list[Column]) -> np.ndarray:
    return np.array(df.agg(*[F.sum(c) for c in columns]).first(), "f8")


def _accuracy(model: Model, df: DataFrame, label: str) -> float:
    return df.agg(F.avg((model.column() == F.col(label).cast("double")).cast("double"))).first()[0]


def logistic(df: DataFrame, features: Sequence[str], label: str, rate: float = 0.01, epochs: int = 100) -> Model:
    """Two classes, 0 and 1; stops where the mean loss changes by less than 1e-6."""
    df = checked(df, features, label).select(*[c.alias(n) for c, n in zip(doubles(features), features, strict=True)], F.col(label).cast("double").alias("y")).cache()
    try:
        x, y = doubles(features), F.col("y")
        n = df.count()
        if not n:
            raise ValueError("no rows to train on")
        w, last = np.zeros(len(features) + 1), np.inf
        for _ in range(epochs):
            p = F.greatest(F.least(sigmoid(dot(w[:-1], x, w[-1])), F.lit(1 - 1e-15)), F.lit(1e-15))
            got = _sums(df, [*[(p - y) * c for c in x], p - y, -(y * F.log(p) + (1 - y) * F.log(1 - p))]) / n
            w -= rate * got[:-1]
            if abs(last - got[-1]) < 1e-6:
                break
            last = got[-1]
        model = Model("logistic_regression", list(features), {"coefficients": w[:-1].tolist(), "intercept": float(w[-1])}, n_samples=n)
        model.extra["accuracy"] = _accuracy(model, df, "y")
        return model
    finally:
        df.unpersist()


def multilogistic(df: DataFrame, features: Sequence[str], label: str, rate: float = 0.1, epochs: int = 500) -> Model:
    """Softmax over the distinct labels; stops where the mean loss changes by less than 1e-7."""
    df, classes = encode_labels(checked(df, features, label), label, "_y")
    if len(classes) < 2:
        raise ValueError("fewer than two classes")
    df = df.select(*[c.alias(n) for c, n in zip(doubles(features), features, strict=True)], "_y", F.col(label).cast("double").alias("y")).cache()
    try:
        x, n, k = [*doubles(features), F.lit(1.0)], df.count(), len(classes)
        w, last = np.zeros((k, len(x))), np.inf
        for _ in range(epochs):
            z = F.array(*[dot(row, x) for row in w])
            top = F.array_max(z)
            e = df.withColumn("_e", F.transform(z, lambda v: F.exp(v - top)))
            e = e.withColumn("_p", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
            hit = [F.col("_p")[c] - (F.col("_y") == c).cast("double") for c in range(k)]
            got = _sums(e, [*[h * v for h in hit for v in x], -F.log(F.greatest(F.get("_p", F.col("_y")), F.lit(1e-15)))]) / n
            w -= rate * got[:-1].reshape(k, len(x))
            if abs(last - got[-1]) < 1e-7:
                break
            last = got[-1]
        model = Model("multilogistic", list(features), {"weights": w.tolist(), "classes": [float(c) for c in classes]}, n_samples=n)
        model.r_squared = model.extra["accuracy"] = _accuracy(model, df, "y")
        return model
    finally:
        df.unpersist()


def ordinal(df: DataFrame, features: Sequence[str], label: str, rate: float = 0.1, epochs: int = 800, tol: float = 1e-7) -> Model:
    """Proportional odds: P(y <= j) = sigmoid(t_j - w x), thresholds kept in order by positive steps exp(d); stops where
    the mean loss changes by less than `tol`."""
    df, classes = encode_labels(checked(df, features, label), label, "_y")
    k = len(classes)
    if k < 2:
        raise ValueError("fewer than two classes")
    df = df.select(*[c.alias(n) for c, n in zip(doubles(features), features, strict=True)], "_y", F.col(label).cast("double").alias("y")).cache()
    try:
        x, n = doubles(features), df.count()
        counts = dict(df.groupBy("_y").count().collect())
        share = np.clip(np.cumsum([counts[c] for c in range(k)])[:-1] / n, 1e-3, 1 - 1e-3)
        t = np.log(share / (1 - share))
        first, gaps, w, last = t[0], np.log(np.maximum(np.diff(t), 1e-3)), np.zeros(len(features)), np.inf
        for _ in range(epochs):
            t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            z = dot(w, x)
            below = [F.lit(0.0), *[sigmoid(F.lit(float(v)) - z) for v in t], F.lit(1.0)]
            e = df.withColumn("_c", F.array(*below))
            lo, hi = F.get("_c", F.col("_y")), F.get("_c", F.col("_y") + 1)
            e = e.select("*", lo.alias("_lo"), hi.alias("_hi"), F.greatest(hi - lo, F.lit(1e-15)).alias("_p"))
            slope = lambda c: F.col(c) * (1 - F.col(c)) / F.col("_p")
            by_z = slope("_hi") - slope("_lo")  # of the loss
            by_t = [F.when(F.col("_y") == j, -slope("_hi")).when(F.col("_y") == j + 1, slope("_lo")).otherwise(0.0) for j in range(k - 1)]
            got = _sums(e, [*[by_z * c for c in x], *by_t, -F.log("_p")]) / n
            gw, gt = got[: len(w)], got[len(w) : -1]
            tail = np.cumsum(gt[::-1])[::-1]
            w, first, gaps = w - rate * gw, first - rate * tail[0], gaps - rate * tail[1:] * np.exp(gaps)
            if abs(last - got[-1]) < tol:
                break
            last = got[-1]
        t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        model = Model("ordinal", list(features), {"coefficients": w.tolist(), "thresholds": t.tolist(), "classes": [float(c) for c in classes]}, n_samples=n)
        model.r_squared = model.extra["accuracy"] = _accuracy(model, df, "y")
        return model
    finally:
        df.unpersist()


def cox(df: DataFrame, time: str, event: str, features: Sequence[str], rate: float = 0.05, epochs: int = 2000) -> Model:
    """Proportional hazards with ties after Breslow, by gradient steps on the mean partial likelihood.

    Rows are summed per distinct time first; running sums over those times, latest first, are the risk sets.
    """
    df = checked(df, features, time, event).select(*[c.alias(n) for c, n in zip(doubles(features), features, strict=True)], F.col(time).cast("double").alias("_t"), F.col(event).cast("double").alias("_d")).cache()
    try:
        n, wrong = df.agg(F.count(F.lit(1)), F.sum(((F.col("_t") <= 0) | ~F.col("_d").isin(0.0, 1.0)).cast("int"))).first()
        if not n or wrong:
            raise ValueError("times must be positive and events 0 or 1")
        x, w, last = doubles(features), np.zeros(len(features)), np.inf
        names = [f"_x{k}" for k in range(len(x))]
        for _ in range(epochs):
            r = F.exp(dot(w, x))
            at = df.groupBy("_t").agg(F.sum("_d").alias("_d"), F.sum(r).alias("_r"), F.sum(F.col("_d") * dot(w, x)).alias("_z"), *[F.sum(r * c).alias(k) for c, k in zip(x, names, strict=True)], *[F.sum(F.col("_d") * c).alias(f"{k}d") for c, k in zip(x, names, strict=True)])
            risk = running_sums(at, "_t", {"s": F.col("_r")} | {f"s{k}": F.col(k) for k in names}, descending=True)
            got = _sums(risk, [*[F.col(f"{k}d") - F.col("_d") * F.col(f"s{k}") / F.col("s") for k in names], F.col("_z") - F.col("_d") * F.log("s")])
            w += rate * got[:-1] / n
            if abs(last + got[-1]) < 1e-6:
                break
            last = -got[-1]
        return Model("cox", list(features), {"coefficients": w.tolist()}, n_samples=n)
    finally:
        df.unpersist()
