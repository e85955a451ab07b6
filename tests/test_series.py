"""Series of a table against loops over one series at a time."""

import numpy as np
import pytest

from sparkloom.operators import tseries


def shocks(y, d, constant, phi, theta):
    z = np.diff(np.array(y, "f8"), d) if d else np.array(y, "f8")
    out = []
    for t in range(len(z)):
        e = z[t] - constant - sum(a * z[t - j] for j, a in enumerate(phi, 1) if t >= j)
        out.append(e - sum(a * out[t - m] for m, a in enumerate(theta, 1) if t >= m))
    return np.array(out)


def simulated(rng, n, phi, theta, constant=0.3):
    e, z = rng.normal(size=n), []
    for t in range(n):
        z.append(constant + e[t] + sum(a * z[t - j] for j, a in enumerate(phi, 1) if t >= j) + sum(a * e[t - m] for m, a in enumerate(theta, 1) if t >= m))
    return z


def lag_fit(y, p, d):
    z = np.diff(np.array(y, "f8"), d) if d else np.array(y, "f8")
    x = np.column_stack([np.ones(len(z) - p), *[z[p - j : len(z) - j] for j in range(1, p + 1)]])
    return np.linalg.lstsq(x, z[p:], rcond=None)[0]


@pytest.mark.parametrize("rows", [40, 100_000])
def test_lags_reach_over_ranges_and_keys(spark, rows):
    rng = np.random.default_rng(4)
    series = {"hot": simulated(rng, 700, [0.6, -0.2], []), "b": simulated(rng, 60, [0.3, 0.1], []), None: simulated(rng, 9, [0.1, 0.2], []), "short": [1.0, 2.0]}
    data = [(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)]
    df = spark.createDataFrame([*data, ("b", None, 1.0), ("b", 5, None)], "k string, t long, y double").repartition(5)
    got = {r.k: r for r in tseries.arima_by(df, ["k"], "t", "y", 2, 1, 0, rows=rows).collect()}
    assert set(got) == set(series) and got["short"].error and got["short"].phi is None
    for k in ("hot", "b", None):
        want = lag_fit(series[k], 2, 1)
        assert np.allclose([got[k].constant, *got[k].phi], want) and got[k].n_samples == len(series[k])
        assert got[k].tail == pytest.approx(series[k][-3:])
    ahead = tseries.forecast_by(tseries.arima_by(df, ["k"], "t", "y", 2, 1, 0, rows=rows), ["k"], 3)
    steps = [r.forecast for r in ahead.where("k = 'b'").orderBy("step").collect()]
    c, a, b = lag_fit(series["b"], 2, 1)
    past = series["b"][-3:]
    for f in steps:
        past.append(past[-1] + c + a * (past[-1] - past[-2]) + b * (past[-2] - past[-3]))
        assert f == pytest.approx(past[-1])


def test_moving_averages_end_where_squares_are_least(spark):
    """Ranges of 40 rows and one range give the same; any small change of a coefficient makes the squares larger."""
    rng = np.random.default_rng(5)
    series = {1: simulated(rng, 400, [0.5], [0.4]), 2: simulated(rng, 90, [0.3], [-0.6])}
    df = spark.createDataFrame([(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)], "k int, t long, y double")
    fine, whole = ({r.k: r for r in tseries.arima_by(df, ["k"], "t", "y", 1, 0, 1, rows=rows).collect()} for rows in (40, 100_000))
    for k, y in series.items():
        a, b = ([r[k].constant, *r[k].phi, *r[k].theta] for r in (fine, whole))
        assert np.allclose(a, b, atol=1e-7)
        loss = lambda v, y=y: (shocks(y, 0, v[0], v[1:2], v[2:]) ** 2).sum()
        for i in range(3):
            for h in (1e-3, -1e-3):
                assert loss(np.array(a) + h * np.eye(3)[i]) > loss(a)
        assert fine[k].shocks == pytest.approx([shocks(y, 0, a[0], a[1:2], a[2:])[-1]], abs=1e-6)
    one = tseries.arima_fit(df.where("k = 1"), "t", "y", 0, 1, 2, rows=60)
    v = np.array([one["constant"], *one["theta"]])
    loss = lambda v: (shocks(series[1], 1, v[0], [], v[1:]) ** 2).sum()
    assert all(loss(v + h * np.eye(3)[i]) > loss(v) for i in range(3) for h in (2e-3, -2e-3))
    assert one["shocks"] == pytest.approx(shocks(series[1], 1, v[0], [], v[1:])[::-1][:2], abs=1e-6)


def test_series_without_a_model(spark):
    flat = spark.createDataFrame([(t, 2.0) for t in range(8)], "t long, y double")
    m = tseries.arima_fit(flat, "t", "y", 1, 0, 0)
    assert (m["phi"], m["constant"]) == ([0.0], 2.0)
    m = tseries.arima_fit(flat, "t", "y", 1, 1, 1)
    assert tseries.arima_forecast(flat, m, 2).orderBy("step").collect()[1].forecast == pytest.approx(2.0)
    with pytest.raises(ValueError, match="at least"):
        tseries.arima_fit(flat.limit(2), "t", "y", 1, 1, 0)
    with pytest.raises(ValueError):
        tseries.arima_fit(flat.limit(0), "t", "y", 1, 0, 0)
