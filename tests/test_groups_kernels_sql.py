"""Models per group, exact kernels, and the SQL functions."""

import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import sql
from sparkloom.model import Model
from sparkloom.operators import grouped, kernels, linear, mining, tree


def test_models_per_group(spark):
    rng = np.random.default_rng(0)
    rows = [(("hot", "b", None)[min(i % 9, 2)] if i % 9 < 3 else "hot", *map(float, rng.normal(size=2)), None if i == 5 else float(rng.normal())) for i in range(400)]
    rows += [("one", 1.0, 2.0, 3.0), ("flat", 1.0, 2.0, 3.0), ("flat", 1.0, 2.5, 4.0), ("flat", 1.0, 3.5, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double, z double, y double").repartition(4)
    models = {r.k: r for r in grouped.linear_by(df, ["k"], ["x", "z"], "y").collect()}
    for k in ("hot", "b", None):
        mine = np.array([r[1:] for r in rows if r[0] == k and r[3] is not None])
        want = np.linalg.lstsq(np.column_stack([mine[:, :2], np.ones(len(mine))]), mine[:, 2], rcond=None)[0]
        assert np.allclose([*models[k].coefficients, models[k].intercept], want) and models[k].n_samples == len(mine)
        alone = linear.linear(df.where(F.col("k").eqNullSafe(F.lit(k))), ["x", "z"], "y")
        assert models[k].mse == pytest.approx(alone.mse) and models[k].r_squared == pytest.approx(alone.r_squared)
    assert all(models[k].coefficients is None and "singular" in models[k].error for k in ("one", "flat"))
    out = grouped.score_by(grouped.linear_by(df, ["k"], ["x", "z"], "y"), df, ["k"], ["x", "z"])
    assert out.count() == len(rows) and out.where("k in ('one', 'flat') and prediction is not null").isEmpty()
    assert out.where("k is null and prediction is null").isEmpty()
    ridge = {r.k: r for r in grouped.linear_by(df, ["k"], ["x", "z"], "y", penalty=3.0).collect()}
    assert np.allclose(ridge["b"].coefficients, linear.linear(df.where("k = 'b'"), ["x", "z"], "y", penalty=3.0).state["coefficients"])
    assert grouped.linear_by(df.limit(0), ["k"], ["x"], "y").count() == 0


def kkt(kind, state, x, y, c, epsilon):
    """How much the rows break the conditions of the optimum, by the model's own weights."""
    weight = {(tuple(a), b): w for a, b, w in zip(state["support"], state["targets"], state["weights"], strict=True)}
    w = np.array([weight.get((tuple(a), b), 0.0) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    f = kernels.decision(state, x)
    if kind == "svr":
        gap = np.abs(y - f) - epsilon
        a = np.abs(w)
    else:
        gap, a = 1 - y * f, w * y
    assert abs(w.sum()) < 1e-6 and (a >= -1e-9).all() and (a <= c + 1e-9).all()
    return max(gap[a < 1e-9].max(initial=0), np.abs(gap[(a > 1e-6) & (a < c - 1e-6)]).max(initial=0), (-gap[a > c - 1e-6]).max(initial=0))


@pytest.mark.parametrize("kernel", kernels.KERNELS)
def test_exact_kernels_for_regression(spark, kernel):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (240, 1))
    y = np.sin(3 * x[:, 0]) + rng.normal(0, 0.02, 240)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:, 0], y, strict=True)], "x double, y double").repartition(3)
    m = kernels.svr(df, ["x"], "y", kernel, gamma=0.5 if kernel == "sigmoid" else 1.0, coef0=1.0 if kernel == "poly" else 0.0, part=60)
    assert m.extra["parts"] == 4 and kkt("svr", m.state, x, y, 1.0, 0.1) < 0.01
    assert m.r_squared > {"linear": 0.6, "sigmoid": 0.2}.get(kernel, 0.98)
    again = Model.from_json(m.to_json()).transform(df, "q").withColumn("p", m.column())
    assert again.where("abs(p - q) > 1e-9").isEmpty() and m.extra["rho"] == -m.state["bias"]


def test_exact_kernels_for_two_classes(spark):
    rng = np.random.default_rng(42)
    r, angle = np.where(np.arange(300) % 2 == 0, 1, 3) + rng.normal(0, 0.4, 300), rng.uniform(0, 6.28, 300)
    x = np.column_stack([r * np.cos(angle), r * np.sin(angle)])
    y = np.arange(300) % 2
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, *rows[:50]], "f0 double, f1 double, y double")  # repeated rows weigh twice
    m = kernels.svm(df.limit(10**9), ["f0", "f1"], "y", part=80)
    assert m.extra["accuracy"] >= 0.95 and 0 < m.extra["n_support"] < 300
    alone = kernels.svm(df.limit(10**9), ["f0", "f1"], "y", part=10_000)
    far = np.abs(kernels.decision(m.state, x) - kernels.decision(alone.state, x)).max()
    assert far < 0.02  # the cascade is the solution of all rows together
    poly = kernels.svm(df, ["f0", "f1"], "y", "poly", gamma=0.5, degree=2, coef0=1.0, part=80)
    assert poly.extra["accuracy"] >= 0.95
    with pytest.raises(ValueError, match="0 or 1"):
        kernels.svm(df.withColumn("y", F.col("y") + 1), ["f0", "f1"], "y")
    with pytest.raises(Exception, match="support vectors"):
        kernels.svm(df.withColumn("y", (F.rand(1) > 0.5).cast("double")), ["f0", "f1"], "y", part=80, most=50)


def test_sql_functions(spark):
    sql.register(spark)
    rng = np.random.default_rng(3)
    rows = [(("a", "b", "c")[i % 3], float(rng.normal()), float(rng.normal()), float(i), i) for i in range(300)] + [("a", None, 1.0, 2.0, 0), ("z", 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, x double, z double, y double, m int").repartition(4)
    df.createOrReplaceTempView("trained")
    got = {r.k: r for r in spark.sql("SELECT * FROM ml_train(TABLE(trained) PARTITION BY k, label => 'y', features => 'x, z', keys => 'k')").collect()}
    want = {r.k: r for r in grouped.linear_by(df, ["k"], ["x", "z"], "y").collect()}
    assert set(got) == set(want) and got["z"].coefficients is None
    assert all(np.allclose([*got[k].coefficients, got[k].intercept, got[k].r_squared], [*want[k].coefficients, want[k].intercept, want[k].r_squared]) for k in "abc")
    for penalty in (0.0, 5.0):
        fit = spark.sql(f"SELECT * FROM ml_fit(TABLE(SELECT * FROM ml_moments(TABLE(trained), label => 'y', features => 'x, z')) WITH SINGLE PARTITION, penalty => {penalty}D)").collect()
        whole = linear.linear(df, ["x", "z"], "y", penalty)
        assert len(fit) == 1 and np.allclose(fit[0].coefficients, whole.state["coefficients"]) and fit[0].n_samples == 301
    scored = spark.sql(f"SELECT * FROM ml_predict(TABLE(trained), model => '{fit[0].model}')")
    assert scored.columns == [*df.columns, "prediction"]
    assert scored.withColumn("p", whole.column()).where("abs(p - prediction) > 1e-6 or (p is null) <> (prediction is null)").isEmpty() and scored.count() == len(rows)
    for name, model in (("whole", whole), ("stump", tree.decision_tree(df, ["x", "z"], "y", max_depth=2)), ("cubic", linear.polynomial(df, ["x"], "y", 3))):
        sql.publish(spark, f"of_{name}", model)
        out = spark.sql(f"SELECT *, of_{name}({', '.join(model.features)}) AS q FROM trained").withColumn("p", model.column())
        assert out.where("x is not null and abs(p - q) > 1e-6").isEmpty()
    for bad in ("SELECT * FROM ml_train(TABLE(trained), label => 'k', features => 'x')", "SELECT * FROM ml_train(TABLE(trained), label => 'y', features => 'nope')"):
        with pytest.raises(Exception, match="not a number|no such column"):
            spark.sql(bad).collect()


def test_sums_and_scores_in_batches(spark):
    """Whole tables meet Python in Arrow batches, with the results of the row-by-row function."""
    sql.register(spark)
    rng = np.random.default_rng(5)
    rows = [(f"é{k}" if k % 7 else None, datetime.datetime(2024, 3, 31, 1, k % 60, tzinfo=datetime.timezone.utc), [k, None], None if k % 11 == 3 else float(rng.normal()), None if k % 13 == 5 else k % 17, Decimal(k) / 100, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, t timestamp, a array<long>, x double, m long, d decimal(12,2), y double").repartition(3)
    df.createOrReplaceTempView("batched")
    sums = spark.sql("SELECT * FROM ml_moments(TABLE(batched), label => 'y', features => 'x, m, d')")
    assert "ArrowEvalPythonUDTF" in (plan := sums._jdf.queryExecution().toString()) and "BatchEvalPythonUDTF" not in plan
    assert sum(r.n for r in sums.collect()) == sum(r[3] is not None and r[4] is not None for r in rows)
    whole = linear.linear(df, ["x", "m", "d"], "y", 2.0)
    for model in (whole, Model("logistic_regression", ["m", "d", "x"], {"coefficients": [0.5, -0.25, 400.0], "intercept": 0.1})):
        sql.publish_table(spark, "of_batch", model, df.schema)
        fast = spark.sql("SELECT * FROM of_batch(TABLE(batched))")
        slow = spark.sql(f"SELECT * FROM ml_predict(TABLE(batched), model => '{model.to_json()}')")
        assert fast.schema == slow.schema and "BatchEvalPythonUDTF" not in fast._jdf.queryExecution().toString()
        got, want = ({r.y: r for r in f.collect()} for f in (fast, slow))
        assert len(got) == len(rows) and all(got[y][:-1] == r[:-1] for y, r in want.items())
        assert all((got[y].prediction is None) == (r.prediction is None) == (r.x is None or r.m is None) for y, r in want.items())
        assert np.allclose(*[[f[y].prediction for y in sorted(f) if f[y].prediction is not None] for f in (got, want)], rtol=1e-12, atol=0)  # exp of -500 carries 500 roundings
    assert spark.sql("SELECT * FROM of_batch(TABLE(SELECT * FROM batched WHERE y < 0))").isEmpty()
    assert spark.sql("SELECT * FROM ml_fit(TABLE(SELECT * FROM ml_moments(TABLE(SELECT * FROM batched WHERE y < 0), label => 'y', features => 'x')) WITH SINGLE PARTITION)").isEmpty()
    for bad, says in (("ml_moments(TABLE(batched), label => 's', features => 'x')", "s is not a number"), ("ml_moments(TABLE(batched), label => 'y', features => 'z')", "no such column: z"), ("of_batch(TABLE(SELECT y, x FROM batched))", "must be a TABLE of s, t")):
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT * FROM {bad}").collect()
    with pytest.raises(ValueError, match="no such column: x"):
        sql.publish_table(spark, "of_batch", whole, df.drop("x").schema)


def test_rules_from_sql(spark):
    sql.register(spark)
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], [x for x in "pqrstu" if rng.random() < 0.5] + [None, "p"][: k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "tid long, g string, items array<string>").repartition(3)
    df.createOrReplaceTempView("baskets")
    key = lambda r: (tuple(r.antecedent), tuple(r.consequent), round(r.support, 9), round(r.confidence, 9), round(r.lift, 9), r.n_both)
    got = spark.sql("SELECT * FROM ml_assoc_rules(TABLE(baskets) WITH SINGLE PARTITION, items => 'items', min_support => 0.2, min_confidence => 0.5)").collect()
    assert len(got) > 10 and sorted(map(key, got)) == sorted(map(key, mining.association_rules(df, "tid", "items", 0.2, 0.5).collect()))
    apart = spark.sql("SELECT * FROM ml_assoc_rules(TABLE(baskets) PARTITION BY g, items => 'items', min_support => 0.3, min_confidence => 0.6)").collect()
    assert sorted(map(key, apart)) == sorted(key(r) for g in "ab" for r in mining.association_rules(df.where(F.col("g") == g), "tid", "items", 0.3, 0.6).collect())


def test_kernels_of_more_support_vectors_than_a_task_may_hold(spark):
    """Half of the rows are support vectors, over `most`: the optimum in the span of a few rows is that of the cascade."""
    rng = np.random.default_rng(7)
    x = np.round(rng.uniform(-3, 3, 600), 3)
    y = np.round(np.sin(x) + rng.normal(0, 0.3, 600), 3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)
    m, whole = (kernels.svr(df, ["x"], "y", gamma=1.0, most=most, part=200) for most in (100, 5000))
    at = np.linspace(-3, 3, 50)[:, None]
    assert np.abs(kernels.decision(m.state, at) - kernels.decision(whole.state, at)).max() < 0.01
    assert abs(m.extra["n_support"] - whole.extra["n_support"]) < 10 and len(m.state["support"]) < 100 < m.extra["n_support"]
    two = df.withColumn("y", (F.col("y") > 0.2).cast("double"))
    m, whole = (kernels.svm(two, ["x"], "y", gamma=1.0, most=most, part=200) for most in (100, 5000))
    assert np.abs(kernels.decision(m.state, at) - kernels.decision(whole.state, at)).max() < 0.02
    assert m.extra["accuracy"] == pytest.approx(whole.extra["accuracy"], abs=0.01)
