"""The learning operators against closed forms, brute force and the queries' own SQL."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import queries as catalogue
from sparkloom import stats
from sparkloom.functions import metrics, vectors
from sparkloom.model import Model
from sparkloom.operators import bayes, cluster, decomp, glm, linear, margin, mining, neighbors, network, resample, survival, tree, tseries, validate
from sparkloom.sources import boosted_json
from sparkloom.sources.registry import Registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in got.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 3))
    y = 2 + 3 * x[:, 0] - 1.5 * x[:, 1] + 0.4 * x[:, 2] + rng.normal(0, 0.05, 300)
    return spark.createDataFrame([(k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, f0 double, f1 double, f2 double, y double").cache()


FEATURES = ["f0", "f1", "f2"]


def test_linear_family(noisy):
    rows = noisy.collect()
    x, y = np.array([[r[f] for f in FEATURES] + [1] for r in rows]), np.array([r.y for r in rows])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    for m in (linear.linear(noisy, FEATURES, "y"), linear.lasso(noisy, FEATURES, "y", 1e-9), linear.elastic_net(noisy, FEATURES, "y", 1e-9), linear.robust(noisy, FEATURES, "y", c=50.0), linear.polynomial(noisy, FEATURES, "y", 1)):
        assert np.allclose([*m.state["coefficients"], m.state["intercept"]], want, atol=1e-6) and m.r_squared > 0.999
        assert Model.from_json(m.to_json()).transform(noisy).where(F.abs(F.col("prediction") - F.col("y")) > 0.5).isEmpty()
    with pytest.raises(ValueError, match="singular"):
        linear.linear(noisy.withColumn("f3", F.col("f0") * 2), ["f0", "f3"], "y")
    with pytest.raises(ValueError, match="no such columns"):
        linear.linear(noisy, ["nope"], "y")


def test_robust_ignores_an_outlier(spark):
    df = spark.createDataFrame([(float(k), 1000.0 if k == 10 else 3.0 * k) for k in range(20)], "x double, y double")
    assert linear.robust(df, ["x"], "y").predict_one(df, [20.0]) == pytest.approx(60, abs=1e-3)


def test_margins_network_and_trees_fit(noisy):
    two = noisy.withColumn("c", (F.col("f0") * F.col("f0") + F.col("f1") * F.col("f1") > 1).cast("double"))
    assert margin.svm(two, ["f0", "f1"], "c", gamma=1.0).extra["accuracy"] > 0.93
    assert margin.svm(noisy.withColumn("c", (F.col("y") > 2).cast("double")), FEATURES, "c", "linear").extra["accuracy"] > 0.97
    assert margin.svr(noisy, FEATURES, "y", "linear", epsilon=0.01).r_squared > 0.99
    assert network.mlp_regressor(noisy, FEATURES, "y", steps=60).r_squared > 0.9
    boosted = tree.gradient_boosting(noisy, ["f0", "f1"], "y", rounds=8, rate=0.5, max_depth=2, bins=16)
    assert boosted.r_squared > 0.8
    binary = tree.gradient_boosting(two, ["f0", "f1"], "c", rounds=6, rate=0.5, max_depth=2, binary=True, bins=16)
    assert metrics.binary(binary.transform(two), "c", "prediction").first().accuracy > 0.85
    sides = noisy.withColumn("c", (F.col("y") > 2).cast("double"))
    for bins in (16, None):
        assert tree.adaboost(sides, ["f0", "f1"], "c", rounds=3, bins=bins).transform(sides).where("prediction = c").count() > 240
    for m in (boosted, binary):
        again = boosted_json.parse(boosted_json.dump(m), ["f0", "f1"])
        both = m.transform(two, "p").withColumn("q", again.column())
        assert both.where("abs(p - q) > 1e-9").isEmpty()


def test_adaboost_query_tries_all_midpoints(spark):
    """The registered query against the same boosting in numpy, over all midpoints of distinct values."""
    rows = catalogue._standard(spark, DATA).select("x", "y").dropna().toPandas()
    x, y = rows.x.to_numpy(), np.where(rows.y > 0, 1.0, -1.0)
    v = np.unique(x)
    assert len(v) > 64
    mids, w = (v[1:] + v[:-1]) / 2, np.ones(len(x))
    got = catalogue.FOUND["adaboost"](spark, DATA).orderBy("round").collect()
    assert len(got) == 3
    for r in got:
        error = np.array([w[np.where(x <= t, -1, 1) != y].sum() for t in mids]) / w.sum()
        best = min(error.min(), (1 - error).min())
        t = mids[np.abs(mids - r.threshold).argmin()]  # the query rounds
        mine = w[r.polarity * np.where(x <= t, -1, 1) != y].sum() / w.sum()
        assert abs(t - r.threshold) < 1e-6 and mine == pytest.approx(best, abs=1e-6)
        assert r.alpha == pytest.approx(0.5 * math.log((1 - best) / best), abs=1e-5)
        w = w * np.exp(-r.alpha * y * r.polarity * np.where(x <= t, -1, 1))


def test_forest_splits_at_every_value(spark):
    df = spark.createDataFrame([(float(k), float(k % 2)) for k in range(50) for _ in range(20)], "x double, y double")
    m = tree.random_forest(df, ["x"], "y", trees=2, max_depth=30)
    assert metrics.regression(m.transform(df), "y", "prediction").first().mse < 0.1
    again = Model.from_json(m.to_json()).transform(df, "q").withColumn("p", m.column())
    assert again.where("p <> q").isEmpty()


def test_text_labels_end_to_end(spark, noisy):
    """Every classifier takes text labels and gives them back."""
    df = noisy.withColumn("c", F.when(F.col("y") > 2, "inside").otherwise("outside"))
    for name, params in {"logistic_regression": {"rate": 0.5}, "multilogistic": {"epochs": 8, "rate": 0.5}, "ordinal": {"epochs": 8, "rate": 0.5}, "naive_bayes": {}, "xgboost_binary": {"rounds": 2, "max_depth": 2, "rate": 0.9, "bins": 16}, "adaboost": {"rounds": 2, "bins": 16}, "svm": {"kernel": "linear"}, "rf_classifier": {"trees": 5}, "knn_classifier": {}}.items():
        m = validate.train(df, name, FEATURES, "c", **params)
        assert m.labels == ["inside", "outside"], name
        again = Model.from_json(m.to_json()).transform(df)
        assert again.where("prediction_label = c").count() > 200, name


def test_splits_by_ranges_of_values(noisy, monkeypatch):
    """Sums carried over ranges give the tree that one window gives."""
    whole = tree.decision_tree(noisy, ["f0", "f1"], "y", max_depth=2)
    monkeypatch.setattr(tree, "FEW", 20)
    ranges = tree.decision_tree(noisy, ["f0", "f1"], "y", max_depth=2)
    assert whole.transform(noisy, "p").withColumn("q", ranges.column()).where("abs(p - q) > 1e-9").isEmpty()


def test_boosting_of_classes(spark):
    rng = np.random.default_rng(7)
    centers = [(0, 0), (4, 0), (0, 4)]
    df = spark.createDataFrame([(*map(float, rng.normal(centers[k % 3], 0.8)), ("a", "b", "c")[k % 3]) for k in range(150)], "f0 double, f1 double, y string").cache()
    m = validate.train(df, "xgboost_binary", ["f0", "f1"], "y", rounds=3, rate=0.5, max_depth=2, bins=16)
    assert m.algorithm == "xgboost_multi" and len(m.state["trees"]) == 9 and m.r_squared > 0.9
    assert m.transform(df).where("prediction_label = y").count() / 150 == pytest.approx(m.r_squared)
    half = tree.gradient_boosting(df, ["f0"], "f1", rounds=2, subsample=0.5, max_depth=2, bins=16)
    again = tree.gradient_boosting(df.repartition(3), ["f0"], "f1", rounds=2, subsample=0.5, max_depth=2, bins=16)
    assert half.transform(df, "p").withColumn("q", again.column()).where("abs(p - q) > 1e-9").isEmpty()
    with pytest.raises(ValueError, match="from 0 to 2"):
        tree.gradient_boosting(df, ["f0"], "f1", classes=3)


def test_dbscan_by_brute_force(spark):
    rng = random.Random(4)
    points = [(rng.choice([0, 0.3, 5]) + rng.random() * rng.choice([0.1, 2]), rng.random() * 3) for _ in range(150)]
    points += points[:20] + [(1.0, 1.0)] * 8
    rows = list(enumerate(points))
    near = {i: [j for j, q in rows if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 0.09] for i, p in rows}
    core = {i for i in near if len(near[i]) >= 6}
    name = {i: i for i in core}
    for _ in rows:
        name = {i: min(name[j] for j in near[i] if j in core) for i in core}
    want = {i: (name[i], True) if i in core else (min((name[j] for j in near[i] if j in core), default=None), False) for i in near}
    df = spark.createDataFrame([(i, *p) for i, p in rows], "id long, x double, y double").repartition(3)
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(df, ["x", "y"], "id", 0.3, 6).collect()}
    ties = [i for i in want if not want[i][1] and len({name[j] for j in near[i] if j in core}) > 1]
    assert {i: v for i, v in got.items() if i not in ties} == {i: v for i, v in want.items() if i not in ties}
    assert all(got[i][0] in {name[j] for j in near[i] if j in core} for i in ties)
    assert cluster.dbscan(df.limit(0), ["x", "y"], "id").count() == 0


def test_models_of_rows_series_and_times(spark, noisy):
    from sparkloom.pipelines import Learner

    knn = validate.train(noisy, "knn_regressor", FEATURES, "y", k=1)
    assert Model.from_json(knn.to_json()).transform(noisy).where("prediction <> y").isEmpty()
    y = [5, 9, 12.2, 14.76, 16.808, 18.4464]
    series = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "t long, y double")
    m = validate.train(series, "arima", ["t"], "y", p=1, d=0, q=0)
    got = [r.prediction for r in m.transform(spark.createDataFrame([(1,), (2,), (0,)], "t long")).collect()]
    assert got[:2] == pytest.approx([19.757, 20.806], abs=1e-2) and got[2] is None
    times = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 1)], "t double, e int")
    assert validate.train(times, "kaplan_meier", ["t"], "e").transform(times).first().prediction == 2.0
    two = validate.train(noisy.select("f0", "f1"), "dbscan", ["f0", "f1"], eps=0.8)
    assert len(two.state["centers"]) >= 1
    assert validate.train(times.withColumn("x", F.col("t")), "cox", ["x"], "e", time="t", epochs=3).state["coefficients"][0] < 0
    from pyspark.ml import Pipeline

    staged = Pipeline(stages=[Learner(algorithm="linear_regression", features=FEATURES, label="y")]).fit(noisy).transform(noisy)
    assert metrics.regression(staged, "y", "prediction").first().r2 > 0.99


def test_json_text(spark):
    from sparkloom.sources import json_text

    df = json_text.rows(spark, "[[1, 2], [3, 4.5]]", '["a", "b"]')
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, 1.0, 2.0, "a"), (1, 3.0, 4.5, "b")]
    assert json_text.rows(spark, "[[1], [2]]", "[3, 4]").schema["y"].dataType.simpleString() == "double"
    for features, target in (("[]", None), ("[[1], [2, 3]]", None), ("[[1], [null]]", None), ("[[1]]", "[1, 2]")):
        with pytest.raises(ValueError):
            json_text.rows(spark, features, target)


def test_large_itemsets_are_refused(spark):
    found = spark.createDataFrame([([f"i{k:02}" for k in range(31)], 31, 4), (["i00"], 1, 5)], "items array<string>, size int, n long")
    with pytest.raises(ValueError, match="31 items"):
        mining.rules(found, 9, 0.1)


def test_packed_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, -2.5]), (1, []), (2, None), (3, [None, 3.0])], "k int, v array<float>")
    raw = {r.k: r.b and bytes(r.b) for r in df.select("k", vectors.pack(F.col("v")).alias("b")).collect()}
    assert raw[0] == np.array([1.0, -2.5], "<f4").tobytes() and raw[1] == b"" and raw[2] is None and len(raw[3]) == 8
    back = spark.createDataFrame([(0, raw[0]), (1, b""), (2, None), (3, b"abcde")], "k int, b binary")
    assert {r.k: r.v for r in back.select("k", vectors.unpack(F.col("b")).alias("v")).collect()} == {0: [1.0, -2.5], 1: [], 2: None, 3: None}
    texts = spark.createDataFrame([("0000803F",), (r"\x00\x00\x80?",), ("",)], "t string")
    assert [bytes(r.b).hex() for r in texts.select(vectors.from_text(F.col("t")).alias("b")).collect()] == ["0000803f", "0000803f", ""]
    with pytest.raises(ValueError, match="10000"):
        vectors.similar(spark.createDataFrame([(1, [1.0])], "row_id long, embedding array<float>"), [1.0], 10_001)


def test_naive_bayes_and_neighbours(noisy):
    labelled = noisy.withColumn("c", F.when(F.col("f0") > 0, 5.0).otherwise(2.0))
    assert bayes.naive_bayes(labelled, ["f0"], "c").transform(labelled).where("prediction = c").count() > 270
    got = neighbors.nearest(noisy, noisy, ["f0", "f1"], 3, "id", "id", skip_self=True, block=64).collect()
    x = {r.id: (r.f0, r.f1) for r in noisy.collect()}
    for q in (0, 17, 299):
        want = sorted((math.dist(x[q], x[t]), t) for t in x if t != q)[:3]
        assert [r.tid for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [t for _, t in want]


def test_clusters(spark):
    rows = [(k, 0.1 * k, 0.0) for k in range(20)] + [(100 + k, 5 + 0.1 * k, 5.0) for k in range(20)] + [(999, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    found = cluster.dbscan(df, ["x", "y"], "id", 0.35, 3)
    assert {(r.cluster, r["count"]) for r in found.groupBy("cluster").count().collect()} == {(0, 20), (100, 20), (None, 1)}
    m = cluster.dbscan_model(df, found, ["x", "y"], "id")
    assert np.allclose(m.state["centers"], [[0.95, 0], [5.95, 5]]) and m.mse == pytest.approx(1 / 41)
    near = df.where("id < 999")
    for m in (cluster.kmeans(near, ["x", "y"], 2), cluster.agglomerative(near, ["x", "y"], 2, "single"), cluster.agglomerative(near, ["x", "y"], 2), cluster.fuzzy_cmeans(near, ["x", "y"], 2)):
        assert np.allclose(sorted(m.state["centers"]), [[0.95, 0], [5.95, 5]], atol=0.1)
    with pytest.raises(ValueError):
        cluster.kmeans(near, ["x"], 1000)


def test_single_linkage_of_any_size(spark):
    """The widest gaps of the whole table part the groups, and every row counts; other merging refuses what it can't hold."""
    rng = random.Random(3)
    values = [round(rng.uniform(0, 100), 3) for _ in range(1500)] + [100.9, 250.0, 250.5] + [7.5] * 400
    values = [v for v in values if not 40 < v < 40.6 and not 80 < v < 80.7]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    v = sorted(set(values))
    ends = sorted(sorted(range(len(v) - 1), key=lambda i: (-((v[i + 1] - v[i]) ** 2), -v[i]))[:4])
    edges = [-math.inf, *[v[i] for i in ends], math.inf]
    want = [np.mean([y for y in values if a < y <= b]) for a, b in zip(edges, edges[1:])]
    m = cluster.agglomerative(df, ["x"], 5, "single", most=300)
    assert np.allclose([c[0] for c in m.state["centers"]], want) and m.n_samples == len(values)
    follow = stats.with_next(df.distinct(), "x").orderBy("x").collect()
    assert [(r.x, r.next) for r in follow] == list(zip(v, [*v[1:], None]))
    both = df.withColumn("y", F.col("x"))
    for features in (["x"], ["x", "y"]):
        with pytest.raises(ValueError, match="at most 300"):
            cluster.agglomerative(both, features, 5, "complete", most=300)
    # several features: the tree's groups are those of the gaps, where all features are one
    several = cluster.agglomerative(both.where("x > 80"), ["x", "y"], 3, "single", most=100)
    one = cluster.agglomerative(df.where("x > 80"), ["x"], 3, "single")
    assert np.allclose(sorted(several.state["centers"]), [c * 2 for c in one.state["centers"]]) and several.n_samples == one.n_samples


def test_directions(noisy):
    x = np.array([[r[f] for f in FEATURES] for r in noisy.collect()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(decomp.pca(noisy, FEATURES, 3).state["variance"], values)
    apart = noisy.withColumn("c", (F.col("f0") > 0).cast("int"))
    v = decomp.lda(apart, ["f0", "f1"], "c").state["vectors"]
    assert len(v) == 1 and abs(v[0][0]) > 0.99


def test_gradient_models(noisy):
    two = noisy.withColumn("c", (F.col("y") > 2).cast("double"))
    assert glm.logistic(two, FEATURES, "c", 1.0, 15).extra["accuracy"] > 0.95
    assert glm.multilogistic(two, FEATURES, "c", 1.0, 10).extra["accuracy"] > 0.95
    three = noisy.withColumn("c", F.when(F.col("y") < 0, 0).when(F.col("y") < 3, 1).otherwise(2))
    assert glm.ordinal(three, FEATURES, "c", 0.5, 15).extra["accuracy"] > 0.7
    timed = noisy.select((F.exp(-F.col("f0")) + 0.01).alias("t"), F.lit(1).alias("d"), "f0")
    assert glm.cox(timed, "t", "d", ["f0"], epochs=4).state["coefficients"][0] > 0
    with pytest.raises(ValueError):
        glm.cox(timed.withColumn("t", F.lit(-1.0)), "t", "d", ["f0"])


def test_survival_and_series(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (4.0, 0), (5.0, 1)], "t double, d int")
    curve = {r.time: (r.at_risk, r.events, round(r.survival, 9)) for r in survival.kaplan_meier(df, "t", "d").collect()}
    assert curve == {1.0: (6, 1, round(5 / 6, 9)), 3.0: (4, 2, round(5 / 12, 9)), 5.0: (1, 1, 0.0)}
    assert survival.median_survival(survival.kaplan_meier(df, "t", "d")).first()[0] == 3.0
    series = spark.createDataFrame(list(enumerate([5.0, 9.0, 12.2, 14.76, 16.808, 18.446])), "t long, y double")
    m = tseries.arima_fit(series, "t", "y", 1, 0, 0)
    assert tseries.arima_forecast(series, m, 1).first().forecast == pytest.approx(19.757, abs=1e-2)
    with pytest.raises(ValueError):
        tseries.arima_forecast(series, m, 0)


def test_metrics(spark):
    one = lambda rows: spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, p double")
    r = metrics.evaluate(one([(1, 0.9), (1, 0.4), (0, 0.1)]), "a", "p").first()
    assert (r.tp, r.fp, r.tn, r.fn, r.recall, r.roc_auc) == (1, 0, 1, 1, 0.5, 1.0)
    assert metrics.roc_auc(one([(1, 0.5), (0, 0.5), (1, 0.5)]), "a", "p").first()[0] == 0.5
    assert metrics.roc_auc(one([(1, 0.5)]), "a", "p").first()[0] is None
    r = metrics.evaluate(one([(1, 1), (2, 2), (3, 5)]), "a", "p").first()
    assert (round(r.mse, 9), round(r.mae, 9), round(r.r2, 9)) == (round(4 / 3, 9), round(2 / 3, 9), -1.0)
    with pytest.raises(ValueError):
        metrics.evaluate(one([]), "a", "p")


def test_rules_by_enumeration(spark):
    rng = random.Random(3)
    baskets = [(k, [x for x in "abcdef" if rng.random() < 0.5] + [None]) for k in range(60)]
    df = spark.createDataFrame(baskets, "tid long, items array<string>")
    sets = [frozenset(x for x in b if x) for _, b in baskets]
    sets = [s for s in sets if s]
    n = len(sets)
    count = {c: sum(set(c) <= s for s in sets) for m in range(1, 7) for c in itertools.combinations("abcdef", m)}
    often = {c: v for c, v in count.items() if v >= math.ceil(0.15 * n - 1e-9)}
    want = {}
    for c, v in often.items():
        for m in range(1, len(c)):
            for a in itertools.combinations(c, m):
                b = tuple(x for x in c if x not in a)
                if v / count[a] >= 0.5 - 1e-12:
                    want[a, b] = (v / n, v / count[a], v / count[a] * n / count[b])
    got = {(tuple(r.antecedent), tuple(r.consequent)): (r.support, r.confidence, r.lift) for r in mining.association_rules(df, "tid", "items", 0.15, 0.5).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_similarity(spark):
    df = spark.createDataFrame([(9, [1.0, 0.0]), (10, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [-1.0, 0.0]), (8, [None, 1.0])], "row_id long, embedding array<float>")
    assert [(r.row_id, r.score) for r in vectors.similar(df, [1.0, 0.0], 2).collect()] == [(9, 1.0), (10, 1.0)]
    assert vectors.similar(df, [1.0, 0.0], 10).count() == 6
    assert tuple(vectors.scan_counts(df, [1.0, 0.0]).first()) == (8, 1, 1)
    raw = df.select(vectors.pack(F.array(F.lit(1.0).cast("float"))).alias("b")).first()[0]
    assert bytes(raw) == bytes.fromhex("0000803F")
    with pytest.raises(ValueError):
        vectors.similar(df, [0.0, 0.0])


def _message(*fields):
    """Fields (number, value) in the wire format of the model files."""
    out = b""
    for number, v in fields:
        v = v.encode() if isinstance(v, str) else v
        out += bytes([number << 3, v]) if isinstance(v, int) else bytes([number << 3 | 2, len(v)]) + v
    return out


def test_onnx_outputs(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    kind = _message((1, _message((1, 1), (2, _message((1, _message((2, "n"))), (1, _message((1, 2))))))))
    graph = _message((1, _message((1, "x"), (2, "y"), (4, "Neg"))), (2, "g"), (11, _message((1, "x"), (2, kind))), (12, _message((1, "y"), (2, kind))))
    path = tmp_path / "m.onnx"
    path.write_bytes(_message((1, 8), (8, _message((1, ""), (2, 13)))) + b"\x3a" + bytes([len(graph)]) + graph)
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert vectors.onnx_outputs(df, str(path), ["a", "b"]).first().embedding == [-1.0, -2.0]
    m = Model.from_json(vectors.load_onnx(str(path), ["a", "b"]).to_json())
    assert m.transform(df).first().prediction == -1.0


def test_smote_and_votes(spark):
    df = spark.createDataFrame([(k, float(k % 7), 0.0, 0) for k in range(80)] + [(100 + k, 4 + 0.1 * k, 4.0, 1) for k in range(10)], "id long, f0 double, f1 double, y int")
    made = resample.smote(df, ["f0", "f1"], "y", "id", 5, 2.05)
    assert made.count() == 20 and made.where("y <> 1 or f0 < 4 or f0 > 4.9 or f1 <> 4").isEmpty()
    assert sorted(made.collect()) == sorted(resample.smote(df.repartition(5), ["f0", "f1"], "y", "id", 5, 2.05).collect())
    const = lambda v: Model("linear_regression", ["f0"], {"coefficients": [0.0], "intercept": v})
    assert resample.vote([const(1.2), const(3.0), const(0.9)], df).first().prediction == 1.0
    assert resample.vote([const(3.0), const(1.0)], df).first().prediction == 3.0
    assert resample.vote([const(1.0), const(2.0)], df, "mean").first().prediction == 1.5
    with pytest.raises(ValueError):
        resample.vote([], df)


def test_validation(noisy):
    out = validate.cross_validate(noisy, "linear_regression", FEATURES, "y", "id", 3)
    assert out.count() == 3 and out.where("r2 < 0.99 or samples <> 100").isEmpty()
    table, models = validate.compare(noisy, FEATURES, "y", ["linear_regression", "svm", "nothing"])
    assert set(models) == {"experiment_linear_regression"} and table.where("error is not null").count() == 2
    with pytest.raises(ValueError):
        validate.cross_validate(noisy, "linear_regression", FEATURES, "y", "id", 1)


def test_registry(spark, noisy, tmp_path):
    r = Registry(spark, str(tmp_path / "reg"))
    assert r.list_models().count() == 0 and not r.deploy("m").first().success
    m = linear.linear(noisy, FEATURES, "y")
    assert [r.save("m", m), r.save("m", linear.linear(noisy, ["f2"], "y"))] == [1, 2]
    assert r.deploy("m").first().version == 2 and r.deploy("m", "best_score").first().version == 1
    assert r.get("m").state == m.state and r.deploy("m", "rollback").first().version == 2
    assert r.snapshot("m", "noisy", noisy, FEATURES, "y") == r.snapshot("m", "noisy", noisy.repartition(4), FEATURES, "y")
    assert r.list_snapshots("m").count() == 2 and r.list_snapshots("other").count() == 0
    run = r.start_run("e", "first", "m")
    r.log_metric(run, "r2", 0.5)
    r.log_param(run, "k", "3")
    r.finish_run(run)
    assert r.runs("e").first().status == "finished" and r.metrics(run).first().value == 0.5 and r.params(run).first().value == "3"
    r.ensure_experiment("e")
    r.ensure_experiment("e", "classification")
    assert [(x.name, x.task) for x in r.experiments().collect()] == [("e", "classification")]
    r.keep_data("rows", noisy.limit(7))
    assert r.score("m", "rows").count() == 7 and r.score("m", noisy, "p").where("p is null").isEmpty()
    r.publish()
    assert spark.sql("select count(*) from ml_list_models where name = 'm'").first()[0] == 2
    with pytest.raises(KeyError):
        r.data("other")
    r.delete("m")
    assert r.list_models().count() == 0


def test_scoring_streams(spark, noisy, tmp_path):
    """A model scores a stream as it scores a table."""
    noisy.limit(20).write.parquet(str(tmp_path / "in"))
    m = linear.linear(noisy, FEATURES, "y")
    q = m.transform(spark.readStream.schema(noisy.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scored").where("abs(prediction - y) < 0.5").count() == 20
