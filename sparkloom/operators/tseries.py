"""ARIMA of series in a table: as many as there are keys, each as long as it gets.

Rows are sorted by Spark over (key, order) and dealt into ranges, so that neither many short series nor one with a third of
all rows decides a task's size. A range's windows see the few rows before it (its halo), which is all that lags need.
Shocks of moving averages depend on all rows before; but they are linear in the few shocks that enter a range, so that a
range reports its sums for every such shock, and the sums of a series are put together in order, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..model import Model, scorer
from ..plans.graph import cut, stored
from .grouped import linear_by

STATE = "_k string, best array<double>, trial array<double>, loss double, normal array<double>, damp double, shocks array<double>, done boolean"


def ranged(df: DataFrame, keys: Sequence[str], order: str, value: str, halo: int, rows: int = 100_000) -> DataFrame:
    """Rows of all series as _k (the key as text), _o, y and _range, with the `halo` rows before a range marked `_halo`.

    Every range between two others of its series holds at least `halo` rows, so that one range back is enough. Rows
    without order or value don't count. Equal orders go by value.
    """
    if missing := [c for c in [*keys, order, value] if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    key = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keys)])) if keys else F.lit("")
    given = df.select(key.alias("_k"), F.col(order).alias("_o"), F.col(value).cast("double").alias("y")).where("_o is not null and y is not null and not isnan(y)")
    n = given.count()
    parts = max(1, min(10_000, n // rows))
    given = cut(given.repartitionByRange(parts, "_k", "_o", "y").withColumn("_range", F.spark_partition_id()))
    held = {r["_range"]: r["n"] for r in given.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    merged, now, size = {}, 0, 0
    for part in sorted(held):
        merged[part], size = now, size + held[part]
        if size >= max(1, halo):
            now, size = now + 1, 0
    if any(a != b for a, b in merged.items()):
        given = given.withColumn("_range", F.element_at(F.create_map(*[F.lit(v) for kv in merged.items() for v in kv]), F.col("_range")))
    back = Window.partitionBy("_range", "_k").orderBy(F.desc("_o"), F.desc("y"))
    ends = given.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= halo).drop("_r")
    return given.withColumn("_halo", F.lit(False)).unionByName(ends.withColumn("_range", F.col("_range") + 1).withColumn("_halo", F.lit(True)))


def lagged(laid: DataFrame, d: int, lags: int) -> DataFrame:
    """_k, _range, _o, y and z0, z1, ...: the series differenced d times, and its lags (null before its start)."""
    w = Window.partitionBy("_range", "_k").orderBy("_o", "y")
    past = laid.select("*", *[F.lag("y", j).over(w).alias(f"_y{j}") if j else F.col("y").alias("_y0") for j in range(d + lags + 1)])
    z = lambda j: sum((F.lit(float((-1) ** i * comb(d, i))) * F.col(f"_y{j + i}") for i in range(1, d + 1)), F.col(f"_y{j}"))
    return past.where("not _halo").select("_k", "_range", "_o", "y", *[z(j).alias(f"z{j}") for j in range(lags + 1)])


def filtered(u: np.ndarray, theta: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows y of y_t = u_t - sum theta_m y_(t-m); start[:, i] is y_(-1-i). In about 2 sqrt(n) steps of whole arrays."""
    k, n, q = len(u), u.shape[1], len(theta)
    width = max(q, isqrt(n) + 1)
    y = np.zeros((k, -(-n // width) * width))
    y[:, :n] = u
    y = y.reshape(k, -1, width)
    answer = np.zeros((q, q + width))  # to a past of one shock of 1
    answer[np.arange(q), q - 1 - np.arange(q)] = 1
    for t in range(width):
        for m in range(q):
            if m < t:
                y[:, :, t] -= theta[m] * y[:, :, t - 1 - m]
            answer[:, q + t] -= theta[m] * answer[:, q + t - 1 - m]
    state = start
    for b in range(y.shape[1]):
        y[:, b] += state @ answer[:, q:]
        state = y[:, b, ::-1][:, :q]
    return y.reshape(k, -1)[:, :n]


def _basis(z: np.ndarray, p: int, q: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of a range's shocks and their slopes, and the last q of each, for every shock that may enter it.

    z holds the differenced series and its p lags. Rows of the basis: the shocks with none entering; the answers to each
    entering shock; slopes by constant and lags; for each theta, the slope by the first and by each of the answers.
    """
    phi, theta = beta[1 : 1 + p], beta[1 + p :]
    u = z[0] - beta[0] - phi @ z[1:]
    first = filtered(np.concatenate([u[None], np.zeros((q, len(u)))]), theta, np.concatenate([np.zeros((1, q)), np.eye(q)]))
    past = np.concatenate([np.concatenate([np.zeros((1, q)), np.eye(q)[:, ::-1]]), first], axis=1)
    plain = -np.concatenate([np.ones((1, len(u))), z[1:]])
    before = [-past[:, q - m : past.shape[1] - m] for m in range(1, q + 1)]
    slopes = filtered(np.concatenate([plain, *before]), theta, np.zeros((1 + p + q * (1 + q), q)))
    all_ = np.concatenate([first, slopes])
    ends = np.concatenate([past, np.concatenate([np.zeros((len(slopes), q)), slopes], axis=1)])[:, ::-1][:, :q]
    return all_ @ all_.T, ends


def _sums(p: int, q: int):
    def run(segment: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(segment) or not len(asked):
            return pd.DataFrame({"_k": pd.Series([], dtype=object), "_range": pd.Series([], dtype="i4"), "gram": pd.Series([], dtype=object), "ends": pd.Series([], dtype=object)})
        z = segment.sort_values(["_o", "y"])[[f"z{j}" for j in range(p + 1)]].to_numpy("f8").T
        with np.errstate(all="ignore"):
            gram, ends = _basis(np.nan_to_num(z), p, q, np.asarray(asked["trial"].iloc[0], "f8"))
        return pd.DataFrame({"_k": segment["_k"].iloc[:1].to_numpy(), "_range": segment["_range"].iloc[:1].to_numpy(), "gram": [gram.ravel()], "ends": [ends.ravel()]})

    return run


def _moved(p: int, q: int):
    """One step of a damped least-squares search per series, from its ranges' sums in order."""
    n, k = 2 + p + q, 1 + q + 1 + p + q * (1 + q)

    def run(ranges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(states):
            return states
        s = states.iloc[0].to_dict()
        if s["done"] or not len(ranges):
            return pd.DataFrame([s])
        total, entering = np.zeros((n, n)), np.zeros((n, q))
        with np.errstate(all="ignore"):
            for r in ranges.sort_values("_range").itertuples():
                mix = np.zeros((n, k))
                mix[:, 1 : 1 + q] = entering
                mix[0, 0] = 1
                mix[1 + np.arange(1 + p), 1 + q + np.arange(1 + p)] = 1
                for m in range(q):
                    at = 2 + q + p + m * (1 + q)
                    mix[2 + p + m, at] = 1
                    mix[2 + p + m, at + 1 : at + 1 + q] = entering[0]
                total += mix @ np.asarray(r.gram, "f8").reshape(k, k) @ mix.T
                entering = mix @ np.asarray(r.ends, "f8").reshape(k, q)
        gain = s["loss"] - total[0, 0]
        better = np.isfinite(total).all() and np.isfinite(entering[0]).all() and not total[0, 0] > s["loss"]
        if better:
            s |= {"best": s["trial"], "loss": float(total[0, 0]), "normal": total.ravel(), "shocks": entering[0], "damp": max(s["damp"] / 10, 1e-12)}
        else:
            s["damp"] *= 10
        best = np.asarray(s["best"], "f8")
        if s["normal"] is None or not len(s["normal"]):
            s["done"] = True
            return pd.DataFrame([s])
        m = np.asarray(s["normal"], "f8").reshape(n, n)
        a = m[1:, 1:] + np.diag(s["damp"] * np.diag(m[1:, 1:]) + 1e-300)
        step = -np.linalg.lstsq(a, m[1:, 0], rcond=None)[0]
        s["trial"] = best + step
        s["done"] = bool(s["damp"] > 1e12 or abs(gain) <= 1e-11 * s["loss"] or (better and np.abs(step).max() <= 1e-8 * (1 + np.abs(best).max())))
        return pd.DataFrame([s])

    return run


def arima_by(df: DataFrame, keys: Sequence[str], order: str, value: str, p: int = 1, d: int = 1, q: int = 0, rounds: int = 50, rows: int = 100_000) -> DataFrame:
    """A row per series: its keys, constant, phi, theta, tail, shocks, n_samples, and the error of one that has no model.

    Without moving average, least squares on the lags, in one aggregation. With it, the sum of squared shocks, those
    before the start being 0, is minimised by damped Gauss-Newton steps (Levenberg and Marquardt), one pass over the rows
    for a step of all series, until none moves. Of a series with a singular system the constant is its mean, and all
    other coefficients are 0. A series of under p + d + q + 2 rows has no model. A null key is a series.
    """
    if p < 0 or d < 0 or q < 0 or p + q < 1:
        raise ValueError("p + q must be 1 or more, and none negative")
    end = d + max(p, 1)
    laid = cut(ranged(df, keys, order, value, end, rows))
    frame = lagged(laid, d, p)
    own = laid.where("not _halo")
    sizes = own.groupBy("_k").agg(F.count(F.lit(1)).alias("n_samples"), F.max("_range").alias("_last"))
    back = Window.partitionBy("_range", "_k").orderBy(F.desc("_o"), F.desc("y"))
    tails = own.join(sizes.select("_k", "_last"), "_k").where(F.col("_range") >= F.col("_last") - 1).withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= end)
    tails = tails.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_o", "y"))).alias("t")).select("_k", F.slice("t", F.greatest(F.size("t") - end + 1, F.lit(1)), end)["y"].alias("tail"))
    z = frame.where("z0 is not null")
    means = z.groupBy("_k").agg(F.avg("z0").alias("_mean"))
    if p:
        fits = linear_by(z, ["_k"], [f"z{j}" for j in range(1, p + 1)], "z0").select("_k", F.col("coefficients").alias("phi"), F.col("intercept").alias("constant"))
        fits = means.join(fits, "_k", "left")
    else:
        fits = means.withColumns({"phi": F.array().cast("array<double>"), "constant": F.col("_mean")})
    flat = F.transform(F.sequence(F.lit(1), F.lit(p)), lambda _: F.lit(0.0)) if p else F.array().cast("array<double>")
    fits = fits.select("_k", F.when(F.col("constant").isNull(), flat).otherwise(F.col("phi")).alias("phi"), F.coalesce("constant", "_mean").alias("constant"))
    none = F.array().cast("array<double>")
    models = fits.withColumns({"theta": none, "shocks": none})
    if q:
        models = _shocks(cut(z.select("_k", "_range", "_o", "y", *[f"z{j}" for j in range(p + 1)])), fits.join(sizes.where(F.col("n_samples") >= p + d + q + 2), "_k", "left_semi"), p, q, rounds)
    out = sizes.join(tails, "_k").join(models, "_k", "left")
    short = F.col("n_samples") < p + d + q + 2
    named = df.select(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keys)])).alias("_k") if keys else F.lit("").alias("_k"), *keys)
    if keys:
        out = named.groupBy("_k").agg(*[F.first(c).alias(c) for c in keys]).join(out, "_k")
    fields = [F.when(~short, F.col(c)).alias(c) for c in ("constant", "phi", "theta", "shocks")]
    error = F.when(short, F.lit(f"a series needs at least {p + d + q + 2} rows"))
    return out.select(*keys, F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"), *fields, "tail", "n_samples", error.alias("error"))


def _shocks(z: DataFrame, fits: DataFrame, p: int, q: int, rounds: int) -> DataFrame:
    """_k, phi, constant, theta and the last q shocks of each series."""
    start = F.concat(F.array("constant"), "phi", F.array(*[F.lit(0.0)] * q))
    states = cut(fits.select("_k", start.alias("best"), start.alias("trial"), F.lit(float("inf")).alias("loss"), F.array().cast("array<double>").alias("normal"), F.lit(1e-3).alias("damp"), F.array(*[F.lit(0.0)] * q).alias("shocks"), F.lit(False).alias("done")))
    z = z.repartition("_k", "_range").cache()
    try:
        spans = cut(z.select("_k", "_range").distinct())
        for _ in range(rounds):
            asked = spans.join(states.where("not done").select("_k", "trial"), "_k")
            asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
            sums = z.groupBy("_k", "_range").cogroup(asked.groupBy("_k", "_range")).applyInPandas(_sums(p, q), "_k string, _range int, gram array<double>, ends array<double>")
            states = stored(sums.groupBy("_k").cogroup(states.groupBy("_k")).applyInPandas(_moved(p, q), STATE))
            if states.where("not done").isEmpty():
                break
    finally:
        z.unpersist()
    phi = F.slice("best", 2, p) if p else F.array().cast("array<double>")
    return states.select("_k", phi.alias("phi"), F.col("best")[0].alias("constant"), F.slice("best", 2 + p, q).alias("theta"), "shocks")


def arima_fit(df: DataFrame, order: str, value: str, p: int = 1, d: int = 1, q: int = 0, rounds: int = 50, rows: int = 100_000) -> dict:
    """The model of a table that is one series; see `arima_by`."""
    r = arima_by(df, [], order, value, p, d, q, rounds, rows).first()
    if r is None or r["error"]:
        raise ValueError(r["error"] if r else "no rows to train on")
    return {c: r[c] for c in ("p", "d", "q", "phi", "theta", "constant", "tail", "shocks")}


def forecast_by(models: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """keys, step (from 1) and forecast of every series that has a model."""
    if not 1 <= horizon <= 100_000:
        raise ValueError("horizon must be from 1 to 100000")

    @F.pandas_udf(ArrayType(DoubleType()))
    def ahead(m: pd.DataFrame) -> pd.Series:
        return pd.Series([forecasts(r._asdict(), horizon) for r in m.itertuples(index=False)], dtype=object)

    found = models.where("error is null").select(*keys, ahead(F.struct("p", "d", "q", "phi", "theta", "constant", "tail", "shocks")).alias("_f"))
    return found.select(*keys, F.posexplode("_f").alias("step", "forecast")).withColumn("step", F.col("step") + 1)


def arima_forecast(df_like: DataFrame, model: dict, horizon: int) -> DataFrame:
    """step (from 1) and forecast."""
    if not 1 <= horizon <= 100_000:
        raise ValueError("horizon must be from 1 to 100000")
    return df_like.sparkSession.createDataFrame(list(enumerate(forecasts(model, horizon), 1)), "step int, forecast double")


def arima(df: DataFrame, features: Sequence[str], label: str, p: int = 1, d: int = 1, q: int = 0) -> Model:
    """A series, in the order of its one feature, as a model: its score of a number h is the forecast h steps ahead."""
    if len(features) != 1:
        raise ValueError("one feature, which orders the series, is needed")
    return Model("arima", list(features), arima_fit(df, features[0], label, p, d, q), n_samples=df.count())


@scorer("arima")
def _arima(state: dict, x: list[Column]) -> Column:
    @F.arrow_udf("double")
    def ahead(steps: pa.Array) -> pa.Array:
        h = steps.fill_null(0).to_numpy().astype("i8")
        path = np.array([np.nan, *forecasts(state, min(int(h.max(initial=1)), 100_000))])
        return pa.array(np.where((h >= 1) & (h < len(path)), path[np.clip(h, 0, len(path) - 1)], np.nan))

    return F.nanvl(ahead(x[0]), F.lit(None).cast("double"))


def forecasts(model: dict, horizon: int) -> list[float]:
    """The next `horizon` values of a fitted series."""
    levels = [np.array(model["tail"], "f8")]
    for _ in range(model["d"]):
        levels.append(np.diff(levels[-1]))
    past, shocks = levels[-1].tolist()[::-1], list(model["shocks"])
    ends = [x[-1] for x in levels[:-1]]
    out = []
    for _ in range(horizon):
        z = model["constant"] + sum(a * v for a, v in zip(model["phi"], past, strict=False)) + sum(a * v for a, v in zip(model["theta"], shocks, strict=False))
        past, shocks = [z, *past][: max(model["p"], 1)], [0.0, *shocks][: model["q"]]
        for k in range(len(ends) - 1, -1, -1):
            ends[k] += z
            z = ends[k]
        out.append(float(z))
    return out
