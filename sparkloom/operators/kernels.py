"""Support vector machines with exact kernels: linear, rbf, poly and sigmoid.

Equal rows fold into one whose bound on its weight is as many times C. A cascade deals the rows into parts and solves each
in a task; the support vectors of two parts are merged and solved again, until one set is left. Then all rows are held
against it: those that break its conditions join it, and it is solved again, until none does. What is found is so the
solution for all rows, within `tol`, though no task ever holds more than a part and the support vectors.

Support vectors grow with the rows, as every row outside the margin is one. Tables of over `most` distinct rows are so solved
in the span of a few of their rows, where all others lie within rounding: a pivoted Cholesky factor over all rows finds
these, and Newton steps on sums over all rows find the weights, by a loss whose corners are rounded within `tol`. Its slopes
are the rows' weights: those between the bounds are within `tol` of the margin. Where `most` rows, or BASIS, don't span the
others, the cascade runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, dot, doubles
from ..model import Model, scorer
from ..plans.graph import cut

KERNELS = ("linear", "rbf", "poly", "sigmoid")


def gram(state: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of every row of a with every row of b."""
    kernel, gamma = state["kernel"], state["gamma"]
    if kernel == "rbf":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(square, 0))
    inner = a @ b.T
    if kernel == "linear":
        return inner
    if kernel == "poly":
        return (gamma * inner + state["coef0"]) ** state["degree"]
    return np.tanh(gamma * inner + state["coef0"])


def solve(k: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, epsilon: float, tol: float, rounds: int = 200_000) -> tuple[np.ndarray, float]:
    """Weights w with low <= w <= high and sum zero that minimise w'kw / 2 - y'w + epsilon |w|, and the offset.

    Each round moves the pair of weights that gains most, one up and one down, up to a bound or to zero, where the slope
    of epsilon |w| changes.
    """
    w, g, diagonal = np.zeros(len(y)), -y.astype("f8"), np.diag(k)
    edge = 1e-12 * np.maximum(1, np.maximum(high, -low))
    for _ in range(rounds):
        up = np.where(w < high - edge, g + np.where(w >= 0, epsilon, -epsilon), np.inf)
        down = np.where(w > low + edge, g + np.where(w > 0, epsilon, -epsilon), -np.inf)
        i = int(up.argmin())
        gap = down - up[i]
        if gap.max() <= tol:
            break
        eta = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.where(gap > 0, gap * gap / eta, -1).argmax())
        step = min(gap[j] / eta[j], high[i] - w[i], w[j] - low[j])
        if w[i] < 0:
            step = min(step, -w[i])
        if w[j] > 0:
            step = min(step, w[j])
        w[i] += step
        w[j] -= step
        for at, turn in ((i, 0.0), (j, 0.0)):
            if abs(w[at]) <= edge[at]:
                w[at] = turn
        g += step * (k[i] - k[j])
    up = np.where(w < high - edge, g + np.where(w >= 0, epsilon, -epsilon), np.inf)
    down = np.where(w > low + edge, g + np.where(w > 0, epsilon, -epsilon), -np.inf)
    ends = [v for v in (up.min(), down.max()) if np.isfinite(v)]
    return w, -float(np.mean(ends)) if ends else 0.0


def _bounds(kind: str, y: np.ndarray, n: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    if kind == "svr":
        return -c * n, c * n
    return np.where(y > 0, 0, -c * n), np.where(y > 0, c * n, 0)


KINDS = "part long, x array<double>, y double, n long, w double, b double"


def _solved(kind: str, state: dict, c: float, epsilon: float, tol: float, most: int):
    """The support vectors of a part."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "n"], kind="stable")
        x, y, n = np.array(group["x"].tolist(), "f8"), group["y"].to_numpy("f8"), group["n"].to_numpy("f8")
        order = np.lexsort((*x.T, y))  # one order, however rows arrived
        x, y, n = x[order], y[order], n[order]
        if len(y) > most:
            raise ValueError(f"over {most} rows in one set of support vectors: raise `most`, widen epsilon or lower c")
        w, b = solve(gram(state, x, x), y, *_bounds(kind, y, n, c), epsilon, tol)
        on = np.abs(w) > 1e-9
        on[: 1 if not on.any() else 0] = True  # a part of one class has none: one row stands for it
        return pd.DataFrame({"part": int(group["part"].iloc[0]) // 2, "x": x[on].tolist(), "y": y[on], "n": n[on].astype("i8"), "w": w[on], "b": b})

    return run


def decision(state: dict, x: np.ndarray) -> np.ndarray:
    s, w = np.array(state["support"], "f8").reshape(-1, x.shape[1]), np.array(state["weights"], "f8")
    out = np.full(len(x), state["bias"])
    for at in range(0, len(x), 1024):
        out[at : at + 1024] += gram(state, x[at : at + 1024], s) @ w
    return out


def _breaking(kind: str, state: dict, epsilon: float, tol: float):
    """Rows outside the support vectors that break the solution's conditions, and by how much."""
    held = {(tuple(x), y) for x, y in zip(state["support"], state["targets"], strict=True)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.array(batch["x"].tolist(), "f8"), batch["y"].to_numpy("f8")
            f = decision(state, x)
            by = np.abs(y - f) - epsilon if kind == "svr" else 1 - y * f
            some = batch.assign(by=by)[by > tol]
            new = [(tuple(a), b) not in held for a, b in zip(some["x"], some["y"], strict=True)]
            yield some[np.array(new, bool)][["x", "y", "n", "by"]]

    return run


#: Most rows of a basis, and what may be left of a row's kernel outside its span, as a share of the largest.
BASIS, LEFT = 1000, 1e-9


def _own(state: dict, x: np.ndarray) -> np.ndarray:
    """Kernel of every row with itself."""
    if state["kernel"] == "rbf":
        return np.ones(len(x))
    inner = (x * x).sum(1)
    return inner if state["kernel"] == "linear" else (state["gamma"] * inner + state["coef0"]) ** state["degree"]


def _pivots(state: dict, x: np.ndarray, basis: np.ndarray, left: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x, the furthest outside the span first, until all lie within it or there are `most`; and how far they were."""
    rest = _own(state, x)
    z = np.zeros((len(x), 0))
    if len(basis):
        z = _spanned(state, basis, x)
        rest = rest - (z * z).sum(1)
    found, far = [], []
    while len(found) < most and (k := int(rest.argmax()), rest[k] > left)[1]:
        found.append(k)
        far.append(rest[k])
        column = (gram(state, x, x[k : k + 1])[:, 0] - z @ z[k]) / np.sqrt(rest[k])
        z = np.column_stack([z, column])
        rest = rest - column * column
        rest[k] = 0
    return np.array(found, "i8"), np.array(far)


def _spanned(state: dict, basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Coordinates in which the kernel of rows in the span is an inner product."""
    return np.linalg.solve(_factor(state, basis), gram(state, basis, x)).T


def _factor(state: dict, basis: np.ndarray) -> np.ndarray:
    k = gram(state, basis, basis)
    return np.linalg.cholesky(k + 1e-13 * np.diag(k).max() * np.eye(len(k)))


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    x, y, n = (batch.column(name) for name in ("x", "y", "n"))
    return [x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False).astype("f8")]


def _basis(state: dict, rows: DataFrame, d: int, most: int) -> np.ndarray | None:
    """Rows in whose span all rows lie, or None if they are over `most`."""
    if state["kernel"] == "sigmoid":
        return None  # no inner product
    basis = np.zeros((0, d))
    own = lambda batches: (pa.RecordBatch.from_pydict({"top": [float(_own(state, _arrays(b)[0]).max())]}) for b in batches if len(b))
    left = LEFT * rows.mapInArrow(own, "top double").agg(F.max("top")).first()[0]
    while True:

        def outside(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = _arrays(batch)[0]
                    found, far = _pivots(state, x, basis, left, 64)
                    yield pa.RecordBatch.from_pydict({"x": pa.array(x[found].tolist(), pa.list_(pa.float64())), "far": pa.array(far, pa.float64())})

        some = rows.mapInArrow(outside, "x array<double>, far double").orderBy(F.desc("far"), "x").limit(4 * BASIS).collect()
        if not some:
            return basis
        x = np.array([r.x for r in some], "f8")
        found, _ = _pivots(state, x, basis, left, most + 1 - len(basis))
        basis = np.concatenate([basis, x[found]])
        if len(basis) > most or not len(found):
            return None


def _sums(kind: str, state: dict, basis: np.ndarray, at: np.ndarray, c: float, epsilon: float, round_: float):
    """A task's share of the loss, its gradient and its matrix of second derivatives, and of the rows with a weight."""
    factor = _factor(state, basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(at)
        total = np.zeros(2 + m + m * m)
        for batch in batches:
            if not len(batch):
                continue
            x, y, n = _arrays(batch)
            z = np.column_stack([np.linalg.solve(factor, gram(state, basis, x)).T, np.ones(len(x))])
            f, held = z @ at, np.zeros(len(x), bool)
            for sign, over in ((1, y - f - epsilon), (-1, f - y - epsilon)) if kind == "svr" else ((y, 1 - y * f),):
                bent, up = np.abs(over) < round_, over >= round_
                total[0] += c * n @ np.where(bent, (over + round_) ** 2 / (4 * round_), np.where(up, over, 0))
                total[2 : 2 + m] -= z.T @ (sign * c * n * np.where(bent, (over + round_) / (2 * round_), up))
                total[2 + m :] += (z[bent].T @ (z[bent] * (c * n[bent] / (2 * round_))[:, None])).ravel()
                held |= bent | up
            total[1] += held.sum()
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    return run


def _in_span(kind: str, state: dict, rows: DataFrame, basis: np.ndarray, c: float, epsilon: float, tol: float, steps: int = 500) -> tuple[np.ndarray, float, int]:
    """Weights of the basis, the offset, and how many distinct rows are support vectors."""
    m = len(basis) + 1
    ridge = np.append(np.ones(m - 1), 0.0)

    def measured(at: np.ndarray, round_: float) -> tuple[float, int, np.ndarray, np.ndarray]:
        sums = rows.mapInArrow(_sums(kind, state, basis, at, c, epsilon, round_), "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r.sums))).treeReduce(np.add)
        return sums[0] + ridge @ (at * at) / 2, int(sums[1]), sums[2 : 2 + m] + ridge * at, sums[2 + m :].reshape(m, m) + np.diag(ridge)

    low, high, middle = rows.agg(F.min("y"), F.max("y"), F.sum(F.col("y") * F.col("n")) / F.sum("n")).first()
    at, round_ = np.append(np.zeros(m - 1), middle), max((high - low) / 2, tol)
    value, held, slope, bend = measured(at, round_)
    for _ in range(steps):
        move = -np.linalg.solve(bend + 1e-12 * np.trace(bend) / m * np.eye(m), slope)
        if -(slope @ move) <= 1e-9 * max(value, 1e-300):
            if round_ <= tol:
                inverse = np.linalg.inv(_factor(state, basis))
                return inverse.T @ at[:-1], float(at[-1]), held
            round_ = max(round_ / 4, tol)
            value, held, slope, bend = measured(at, round_)
            continue
        share = 1.0
        while True:
            new = measured(at + share * move, round_)
            if new[0] <= value + 1e-4 * share * (slope @ move) or share < 1e-6:
                break
            share /= 2
        at = at + share * move
        value, held, slope, bend = new
    raise RuntimeError(f"no optimum after {steps} steps")


def _train(kind: str, df: DataFrame, features: Sequence[str], label: str, kernel: str, c: float, epsilon: float, gamma: float, degree: int, coef0: float, tol: float, part: int, most: int, rounds: int) -> Model:
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {', '.join(KERNELS)}")
    if c <= 0 or epsilon < 0 or degree < 1:
        raise ValueError("c must be above 0, epsilon 0 or more and degree 1 or more")
    d = len(features)
    state = {"kernel": kernel, "gamma": gamma if gamma > 0 else 1.0 / d, "degree": degree, "coef0": coef0}
    y = F.col(label).cast("double")
    rows = checked(df, features, label).select(F.array(*doubles(features)).alias("x"), y.alias("y"))
    if kind == "svm":
        if not rows.where(~F.col("y").isin(0.0, 1.0)).isEmpty():
            raise ValueError("labels must be 0 or 1")
        rows = rows.select("x", (2 * F.col("y") - 1).alias("y"))
    rows = cut(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    points = rows.count()
    if not points:
        raise ValueError("no rows to train on")
    parts = max(1, -(-points // part))
    if points > most and (basis := _basis(state, rows, d, min(most, BASIS))) is not None:
        weights, bias, held = _in_span(kind, state, rows, basis, c, epsilon, tol)
        state |= {"support": basis.tolist(), "targets": [0.0] * len(basis), "weights": weights.tolist(), "bias": bias}
        return _told(kind, df, features, label, y, state, held, parts)
    step = _solved(kind, state, c, epsilon, tol, most)
    held = rows.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    while True:
        held = cut(held.select("part", "x", "y", "n").groupBy("part").applyInPandas(step, KINDS))
        if parts == 1:
            break
        parts = -(-parts // 2)
    for _ in range(rounds):
        found = held.collect()  # at most `most` rows
        state |= {"support": [list(r.x) for r in found], "targets": [r.y for r in found], "weights": [r.w for r in found], "bias": found[0].b}
        worst = rows.mapInPandas(_breaking(kind, state, epsilon, 2 * tol), "x array<double>, y double, n long, by double").orderBy(F.desc("by"), "x", "y").limit(part)
        worst = cut(worst)
        if worst.isEmpty():
            break
        held = cut(held.select("x", "y", "n").union(worst.select("x", "y", "n")).withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInPandas(step, KINDS))
    else:
        raise RuntimeError(f"rows still break the conditions after {rounds} rounds")
    return _told(kind, df, features, label, y, state, int(sum(w != 0 for w in state["weights"])), max(1, -(-points // part)))


def _told(kind: str, df: DataFrame, features: Sequence[str], label: str, y: Column, state: dict, n_support: int, parts: int) -> Model:
    model = Model(f"kernel_{kind}", list(features), state, extra={"n_support": n_support, "rho": -state["bias"], "parts": parts})
    truth = checked(df, features, label)
    p = model.column()
    r = truth.agg(F.count(F.lit(1)), F.avg((y - p) * (y - p)), F.var_pop(y)).first()
    model.n_samples = r[0]
    if kind == "svr":
        model.mse, model.r_squared = r[1], 1 - r[1] / r[2] if r[2] else None
    else:
        model.extra["accuracy"] = 1 - r[1]
    return model


def svr(df: DataFrame, features: Sequence[str], label: str, kernel: str = "rbf", c: float = 1.0, epsilon: float = 0.1, gamma: float = 0.0, degree: int = 3, coef0: float = 0.0, tol: float = 1e-3, part: int = 1000, most: int = 5000, rounds: int = 50) -> Model:
    """Regression that ignores errors within epsilon. gamma 0 means one by the number of features."""
    return _train("svr", df, features, label, kernel, c, epsilon, gamma, degree, coef0, tol, part, most, rounds)


def svm(df: DataFrame, features: Sequence[str], label: str, kernel: str = "rbf", c: float = 1.0, gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, tol: float = 1e-3, part: int = 1000, most: int = 5000, rounds: int = 50) -> Model:
    """Two classes, 0 and 1, with a soft margin; `extra` has the support vectors' number, rho and the accuracy."""
    return _train("svm", df, features, label, kernel, c, 0.0, gamma, degree, coef0, tol, part, most, rounds)


def _decisions(state: dict, x: list[Column]) -> Column:
    if state["kernel"] == "linear":
        w = np.array(state["weights"]) @ np.array(state["support"], "f8").reshape(-1, len(x))
        return dot(w.tolist(), x, state["bias"])

    @F.pandas_udf("double")
    def go(rows: pd.Series) -> pd.Series:
        there = rows.notna().to_numpy()
        out = np.full(len(rows), np.nan)
        if there.any():
            out[there] = decision(state, np.array(rows[there].tolist(), "f8"))
        return pd.Series(out).where(there, None)

    whole = F.lit(True)
    for c in x:
        whole = whole & c.isNotNull()
    return go(F.when(whole, F.array(*x)))


@scorer("kernel_svr")
def _svr(state: dict, x: list[Column]) -> Column:
    return _decisions(state, x)


@scorer("kernel_svm")
def _svm(state: dict, x: list[Column]) -> Column:
    return (_decisions(state, x) >= 0).cast("double")
