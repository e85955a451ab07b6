"""Gaussian naive Bayes: class moments in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, doubles, first_greatest
from ..model import Model, scorer


def log_likelihoods(state: dict, x: list[Column]) -> list[Column]:
    if len(x) * len(state["priors"]) > 100:  # an expression of that size is past what generated code can hold
        return [_wide(*c, F.array(*x)) for c in zip(state["priors"], state["means"], state["variances"], strict=True)]
    out = []
    for prior, mean, var in zip(state["priors"], state["means"], state["variances"], strict=True):
        ll = F.lit(float(np.log(prior)))
        for c, m, v in zip(x, mean, var, strict=True):
            ll = ll + F.lit(-0.5 * float(np.log(2 * np.pi * v))) - (c - F.lit(float(m))) * (c - F.lit(float(m))) / F.lit(2 * float(v))
        out.append(ll)
    return out


def _wide(prior: float, mean: Sequence[float], var: Sequence[float], x: Column) -> Column:
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    off = F.zip_with(x, array(mean), lambda c, m: (c - m) * (c - m))
    terms = F.zip_with(off, array(var), lambda o, v: o / (2 * v))
    return F.aggregate(terms, F.lit(float(np.log(prior) - 0.5 * np.log(2 * np.pi * np.array(var, "f8")).sum())), lambda a, t: a - t)


@scorer("naive_bayes")
def _naive_bayes(state: dict, x: list[Column]) -> Column:
    return F.element_at(F.array(*[F.lit(float(c)) for c in state["classes"]]), first_greatest(log_likelihoods(state, x)) + 1)


def naive_bayes(df: DataFrame, features: Sequence[str], label: str, smoothing: float = 1e-9) -> Model:
    """Population variances plus `smoothing`; the first class wins ties."""
    x = doubles(features)
    rows = checked(df, features, label).groupBy(F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.var_pop(c).alias(f"v{k}") for k, c in enumerate(x)]).orderBy("y").collect()
    if not rows:
        raise ValueError("no rows to train on")
    n, d = sum(r["n"] for r in rows), range(len(x))
    state = {"classes": [r["y"] for r in rows], "priors": [r["n"] / n for r in rows], "means": [[r[f"m{k}"] for k in d] for r in rows], "variances": [[r[f"v{k}"] + smoothing for k in d] for r in rows]}
    return Model("naive_bayes", list(features), state, n_samples=n)
