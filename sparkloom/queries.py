"""The registered queries of the in-query learning operators, each over whole tables, and their SQL for the oracle.

Doubles are rounded on both sides, as sums run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, sql
from .frame import decode_labels, encode_labels
from .functions import metrics, vectors
from .model import Model
from .operators import bayes, cluster, decomp, glm, grouped, kernels, linear, margin, mining, neighbors, network, resample, survival, tree, tseries, tsne, validate
from .plans.graph import shared_folder
from .sources import boosted_json
from .sources.registry import Registry

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coefficients(spark: SparkSession, model) -> DataFrame:
    """One row: intercept, b1, b2, ..., r_squared, mse (in units that round alike), n_samples."""
    c = model.state["coefficients"]
    row = (round(model.state["intercept"], 3), *[round(x, 3) for x in c], round(model.r_squared, 6), int(model.n_samples))
    return spark.createDataFrame([row], "intercept double, " + ", ".join(f"b{k + 1} double" for k in range(len(c))) + ", r_squared double, n_samples long")


ONE = """SELECT round(my - b * mx, 3) AS intercept, round(b, 3) AS b1, round(1 - (vy - 2 * b * cxy + b * b * vx) / vy, 6) AS r_squared, n AS n_samples
FROM (SELECT *, {b} AS b FROM (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mx, var_pop(l_extendedprice) AS vy, var_pop(l_quantity) AS vx,
covar_pop(l_extendedprice, l_quantity) AS cxy, count(*) AS n FROM lineitem))"""


@query(ONE.format(b="cxy / vx"))
def ols_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.linear(_table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query("""SELECT round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 3) AS b1, round(b2, 3) AS b2,
round((2 * b1 * c1 + 2 * b2 * c2 - b1 * b1 * v1 - b2 * b2 * v2 - 2 * b1 * b2 * c12) / vy, 6) AS r_squared, n AS n_samples
FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM (
SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_extendedprice) AS vy, var_pop(l_quantity) AS v1,
var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_extendedprice, l_quantity) AS c1,
covar_pop(l_extendedprice, l_discount) AS c2, count(*) AS n FROM lineitem))""")
def ols_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.linear(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"))


@query(ONE.format(b="cxy * n / (vx * n + 1000)"))
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.linear(_table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", penalty=1000.0))


@query(ONE.format(b="sign(cxy) * greatest(abs(cxy) / sqrt(vx) - 500, 0) / sqrt(vx)"))
def lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.lasso(_table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", penalty=500.0))


@query(ONE.format(b="sign(cxy) * greatest(abs(cxy) - 50, 0) / (vx + 50)"))
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.elastic_net(_table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", alpha=100.0, l1_ratio=0.5))


@query("""WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_size AS DOUBLE) * p_size AS z, p_retailprice AS y FROM part),
m AS (SELECT avg(y) AS my, avg(x) AS m1, avg(z) AS m2, var_pop(y) AS vy, var_pop(x) AS v1, var_pop(z) AS v2, covar_pop(x, z) AS c12,
covar_pop(y, x) AS c1, covar_pop(y, z) AS c2, count(*) AS n FROM d),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 3) AS b1, round(b2, 3) AS b2,
round((b1 * c1 + b2 * c2) / vy, 6) AS r_squared, n AS n_samples FROM b""")
def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.polynomial(_table(spark, sf_dir, "part"), ["p_size"], "p_retailprice", degree=2))


@query("""WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - a - b * l_quantity)), 3) AS mae FROM lineitem, b GROUP BY l_returnflag""")
def linear_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, score by an expression, and report the error of every group."""
    rows = _table(spark, sf_dir, "lineitem")
    scored = linear.linear(rows, ["l_quantity"], "l_extendedprice").transform(rows)
    return scored.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("prediction"))), 3).alias("mae"))


@query(oracle.robust(5))
def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, linear.robust(_table(spark, sf_dir, "part"), ["p_size"], "p_retailprice", rounds=5))


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels of documents with their standardised length."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    m = rows.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return rows.crossJoin(F.broadcast(m)).select("doc_id", ((F.col("n_chars") - F.col("m")) / F.col("s")).alias("x"), F.col("quality").cast("double").alias("y"))  # m is one row


@query("""WITH RECURSIVE j AS (SELECT d.n_chars, CAST(l.quality AS DOUBLE) AS y FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT (n_chars - (SELECT avg(n_chars) FROM j)) / (SELECT stddev_pop(n_chars) FROM j) AS x, y FROM j),
g(k, w, b) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
SELECT k + 1, w - (SELECT avg((1 / (1 + exp(-(g.w * x + g.b))) - y) * x) FROM s), b - (SELECT avg(1 / (1 + exp(-(g.w * x + g.b))) - y) FROM s) FROM g WHERE k < 5)
SELECT round(b, 6) AS intercept, round(w, 6) AS b1 FROM g WHERE k = 5""")
def logistic_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = glm.logistic(_standard(spark, sf_dir), ["x"], "y", rate=1.0, epochs=5)
    return spark.createDataFrame([(round(m.state["intercept"], 6), round(m.state["coefficients"][0], 6))], "intercept double, b1 double")


@query(oracle.multilogistic(10))
def multilogistic_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = glm.multilogistic(_standard(spark, sf_dir), ["x"], "y", epochs=10)
    return spark.createDataFrame([(c, *[round(v, 6) for v in w]) for c, w in zip(m.state["classes"], m.state["weights"], strict=True)], "class double, b1 double, intercept double")


@query(oracle.ordinal(10))
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select((F.col("p_retailprice") / 1000).alias("x"), F.floor((F.col("p_size") - 1) / 17).alias("y"))
    m = glm.ordinal(rows, ["x"], "y", epochs=10, tol=0.0)
    return spark.createDataFrame([(k, round(t, 6)) for k, t in enumerate(m.state["thresholds"])], "place int, threshold double")


#: A column for each component of an embedding.
DIMS = [f"x{k}" for k in range(64)]


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(x) for k, x in enumerate(DIMS)])


def _fits(model_rows: DataFrame, actual: str, bar: float) -> DataFrame:
    """n, and whether the predictions explain at least the share `bar` of the variance."""
    return metrics.regression(model_rows, actual, "prediction").select("n", (F.col("r2") >= bar).alias("fits"))


@query(oracle.naive_bayes())
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dims(spark, sf_dir)
    return bayes.naive_bayes(rows, DIMS, "label").transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query(oracle.neighbours() + "SELECT qid, round(avg(y), 6) AS prediction FROM r WHERE k <= 5 GROUP BY qid")
def knn_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dims(spark, sf_dir)
    return neighbors.knn_regression(rows, rows, DIMS, "label", 5, "vec_id", "vec_id", skip_self=True).select("qid", F.round("prediction", 6).alias("prediction"))


@query(oracle.neighbours() + """SELECT qid, y AS prediction FROM (SELECT qid, y, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, y) AS o
FROM r WHERE k <= 5 GROUP BY qid, y) WHERE o = 1""")
def knn_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dims(spark, sf_dir)
    return neighbors.knn_classification(rows, rows, DIMS, "label", 5, "vec_id", "vec_id", skip_self=True)


@query("""WITH v AS (SELECT CAST(p_size AS DOUBLE) AS v, count(*) AS n, sum(p_retailprice) AS s, sum(p_retailprice * p_retailprice) AS q FROM part GROUP BY p_size),
w AS (SELECT v, lead(v) OVER o AS nx, sum(n) OVER o AS ln, sum(s) OVER o AS ls, sum(q) OVER o AS lq, sum(n) OVER () AS an, sum(s) OVER () AS s, sum(q) OVER () AS aq FROM v WINDOW o AS (ORDER BY v)),
b AS (SELECT (v + nx) / 2 AS threshold, ls / ln AS l, (s - ls) / (an - ln) AS r, lq - ls * ls / ln + (aq - lq) - (s - ls) * (s - ls) / (an - ln) AS sse FROM w WHERE nx IS NOT NULL AND ln >= 2 AND an - ln >= 2)
SELECT threshold, round(l, 4) AS left_value, round(r, 4) AS right_value FROM b ORDER BY round(sse, 3), threshold LIMIT 1""")
def tree_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree.decision_tree(_table(spark, sf_dir, "part"), ["p_size"], "p_retailprice", max_depth=1).state["tree"]
    return spark.createDataFrame([(t["threshold"], round(t["left"]["value"], 4), round(t["right"]["value"], 4))], "threshold double, left_value double, right_value double")


@query(oracle.gradient_boosting(3))
def gradient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    m = tree.gradient_boosting(rows, ["p_size"], "p_retailprice", rounds=3, max_depth=2)
    out = metrics.regression(m.transform(rows), "p_retailprice", "prediction")
    return out.select("n", F.round("mse", 3).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query(oracle.adaboost(3))
def adaboost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standard(spark, sf_dir)
    m = tree.adaboost(rows, ["x"], "y", rounds=3)
    return spark.createDataFrame([(k, round(s["threshold"], 6), s["polarity"], round(s["alpha"], 6)) for k, s in enumerate(m.state["stumps"])], "round int, threshold double, polarity double, alpha double")


@query("SELECT count(*) AS n, TRUE AS fits FROM embeddings")
def random_forest_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten classes, more than half of the rows must be met."""
    rows = _dims(spark, sf_dir)
    out = tree.random_forest(rows, DIMS, "label", classify=True, trees=20, max_depth=6).transform(rows)
    return out.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("prediction_label") == F.col("label")).cast("double")) >= 0.5).alias("fits"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the characters and of the words of every text."""
    rows = _table(spark, sf_dir, "documents").where("text is not null")
    return rows.select(F.log1p("n_chars").alias("x"), F.log1p(F.size(F.split("text", " "))).alias("y"))


@query("SELECT count(*) AS n, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstraps can't be put in SQL: the forest must explain 0.9 of the variance, of which the mean explains nothing."""
    rows = _lengths(spark, sf_dir)
    return _fits(tree.random_forest(rows, ["x"], "y", trees=10, max_depth=5).transform(rows), "y", 0.9)


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the labelled documents by the looks of their texts."""
    rows = _table(spark, sf_dir, "labels").where("quality is not null").join(_table(spark, sf_dir, "documents").where("text is not null"), "doc_id")
    share = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]", "")) / F.greatest(F.length("text"), F.lit(1))
    words = F.split("text", r"\s+")
    return rows.select(F.col("quality").cast("double").alias("y"), (F.log1p("n_chars") / 5).alias("size"), *[(4 * share(c)).alias(n) for n, c in (("lower", "a-z"), ("upper", "A-Z"), ("digits", "0-9"), ("ends", ".!?"))], (2 * F.size(F.array_distinct(words)) / F.size(words)).alias("fresh"))


@query("""SELECT count(*) AS n, TRUE AS fits FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL""")
def svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radial kernel on the given labels: at most half of the rows that the larger class alone misses may be missed."""
    rows = _looks(spark, sf_dir).cache()
    m = kernels.svm(rows, ["size", "lower", "upper", "digits", "ends", "fresh"], "y", c=10.0, gamma=1.0)
    larger = rows.agg(F.avg("y")).first()[0]
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.lit(1 - m.extra["accuracy"]) <= F.lit(min(larger, 1 - larger) / 2)).alias("fits"))


@query("SELECT count(*) AS n, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def svr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radial kernel: nine tenths of the variance must be explained, of which the mean explains nothing."""
    rows = _lengths(spark, sf_dir)
    return _fits(kernels.svr(rows, ["x"], "y", gamma=1.0).transform(rows), "y", 0.9)


@query("SELECT count(*) AS n, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def svm_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of over 150 words by their characters, by aggregations alone: nine of ten must be met."""
    rows = _lengths(spark, sf_dir).select("x", (F.col("y") > float(np.log(151))).cast("double").alias("y"))
    out = metrics.binary(margin.svm(rows, ["x"], "y", kernel="linear", epochs=5).transform(rows), "y", "prediction")
    return out.select((F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), (F.col("accuracy") >= 0.9).alias("fits"))


@query("SELECT count(*) AS n, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def svr_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir)
    return _fits(margin.svr(rows, ["x"], "y", kernel="linear", epochs=5).transform(rows), "y", 0.8)


@query("SELECT count(*) AS n, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def mlp_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir)
    return _fits(network.mlp_regressor(rows, ["x"], "y", steps=60).transform(rows), "y", 0.8)


@query("SELECT count(*) AS n, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def mlp_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with momentum, in parts side by side."""
    rows = _lengths(spark, sf_dir)
    return _fits(network.mlp_regressor(rows, ["x"], "y", rate=0.01, steps=10, batch=16).transform(rows), "y", 0.8)


@query("""WITH d AS (SELECT c_acctbal / 1000 AS v FROM customer),
p0(a, b, c) AS (VALUES (CAST(0 AS DOUBLE), CAST(4 AS DOUBLE), CAST(8 AS DOUBLE))),
p1 AS (SELECT avg(v) FILTER (abs(v - a) <= least(abs(v - b), abs(v - c))) AS a, avg(v) FILTER (abs(v - b) < abs(v - a) AND abs(v - b) <= abs(v - c)) AS b, avg(v) FILTER (abs(v - c) < least(abs(v - a), abs(v - b))) AS c FROM d, p0),
p2 AS (SELECT avg(v) FILTER (abs(v - a) <= least(abs(v - b), abs(v - c))) AS a, avg(v) FILTER (abs(v - b) < abs(v - a) AND abs(v - b) <= abs(v - c)) AS b, avg(v) FILTER (abs(v - c) < least(abs(v - a), abs(v - b))) AS c FROM d, p1)
SELECT CAST(0 AS INTEGER) AS cluster, round(a, 6) AS center FROM p2 UNION ALL SELECT CAST(1 AS INTEGER), round(b, 6) FROM p2 UNION ALL SELECT CAST(2 AS INTEGER), round(c, 6) FROM p2""")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cluster.kmeans(_table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("v")), ["v"], rounds=2, tol=0.0, centers=[[0.0], [4.0], [8.0]])
    return spark.createDataFrame([(k, round(c[0], 6)) for k, c in enumerate(m.state["centers"])], "cluster int, center double")


@query("""WITH d AS (SELECT c_acctbal / 1000 AS v FROM customer),
u AS (SELECT v, (v - 2) * (v - 2) AS a, (v - 7) * (v - 7) AS b FROM d),
w AS (SELECT v, CASE WHEN a = 0 THEN 1 WHEN b = 0 THEN 0 ELSE 1 / (1 + (a / b) * (a / b)) END AS m FROM u)
SELECT CAST(0 AS INTEGER) AS cluster, round(sum(m * m * v) / sum(m * m), 6) AS center FROM w
UNION ALL SELECT CAST(1 AS INTEGER), round(sum((1 - m) * (1 - m) * v) / sum((1 - m) * (1 - m)), 6) FROM w""")
def fuzzy_cmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cluster.fuzzy_cmeans(_table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("v")), ["v"], rounds=1, centers=[[2.0], [7.0]])
    return spark.createDataFrame([(k, round(c[0], 6)) for k, c in enumerate(m.state["centers"])], "cluster int, center double")


@query("""WITH s AS (SELECT s_suppkey, s_acctbal AS v FROM supplier),
n AS (SELECT s_suppkey, v, count(*) OVER (ORDER BY v RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS k FROM s),
c AS (SELECT s_suppkey, v, CASE WHEN v - lag(v) OVER (ORDER BY v) <= 100 THEN 0 ELSE 1 END AS new FROM n WHERE k >= 3),
g AS (SELECT s_suppkey, v, sum(new) OVER (ORDER BY v, s_suppkey) AS g FROM c),
h AS (SELECT s_suppkey, v, min(s_suppkey) OVER (PARTITION BY g) AS cluster FROM g)
SELECT s_suppkey, coalesce((SELECT cluster FROM h WHERE h.s_suppkey = s.s_suppkey), (SELECT min(cluster) FROM h WHERE abs(h.v - s.v) <= 100)) AS cluster,
EXISTS (SELECT 1 FROM h WHERE h.s_suppkey = s.s_suppkey) AS core FROM s""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(_table(spark, sf_dir, "supplier"), ["s_acctbal"], "s_suppkey", eps=100.0, min_points=3)


@query(oracle.dense_vectors(1.2, 5))
def dbscan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 dimensions."""
    return cluster.dbscan(_dims(spark, sf_dir), DIMS, "vec_id", eps=1.2, min_points=5)


@query()
def tsne_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout can't be put in SQL: whether on it nearest rows are at most half as far from each other as any two are.

    Ten rows, all of them neighbours of each other, can't tell, so that no bar is set for the smallest tables."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    out = tsne.tsne(rows, ["balance", "nation"], "s_suppkey", perplexity=10.0, rounds=20, early=14).cache()
    pairs = neighbors.nearest(rows, rows, ["balance", "nation"], 1, "s_suppkey", "s_suppkey", skip_self=True)
    a, b = out.select(F.col("s_suppkey").alias("qid"), "y1", "y2"), out.select(F.col("s_suppkey").alias("tid"), F.col("y1").alias("z1"), F.col("y2").alias("z2"))
    square = (F.col("y1") - F.col("z1")) * (F.col("y1") - F.col("z1")) + (F.col("y2") - F.col("z2")) * (F.col("y2") - F.col("z2"))
    near = pairs.join(a, "qid").join(b, "tid").agg(F.avg(square).alias("near"))
    spread = out.agg(F.count(F.lit(1)).alias("n"), (2 * (F.var_pop("y1") + F.var_pop("y2"))).alias("any"))  # mean square distance of two rows
    return spread.crossJoin(F.broadcast(near)).select("n", (F.col("near") <= F.col("any") / 4).alias("fits"))  # one row each


@query("""SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS b1, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, count(*) AS n_samples FROM lineitem GROUP BY ALL""")
def linear_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = grouped.linear_by(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], "l_extendedprice")
    return m.select("l_returnflag", "l_linestatus", F.round(F.col("coefficients")[0], 4).alias("b1"), F.round("intercept", 3).alias("intercept"), F.round("r_squared", 6).alias("r_squared"), "n_samples")


@query("""WITH b AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY l_suppkey)
SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - a - b * l_quantity)), 3) AS mae FROM lineitem JOIN b USING (l_suppkey) GROUP BY l_returnflag""")
def predict_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per supplier, and the error of the prices that each supplier's own model gives."""
    rows = _table(spark, sf_dir, "lineitem")
    m = grouped.linear_by(rows, ["l_suppkey"], ["l_quantity"], "l_extendedprice")
    out = grouped.score_by(m, rows, ["l_suppkey"], ["l_quantity"])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("prediction"))), 3).alias("mae"))


@query("""SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS b1, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, count(*) AS n_samples FROM part GROUP BY p_brand""")
def sql_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, a model per brand, from SQL."""
    sql.register(spark)
    _table(spark, sf_dir, "part").createOrReplaceTempView("_part")
    text = "SELECT p_brand, round(coefficients[0], 6) AS b1, round(intercept, 4) AS intercept, n_samples FROM ml_train(TABLE(_part) PARTITION BY p_brand, label => 'p_retailprice', features => 'p_size', keys => 'p_brand')"
    return spark.sql(text)


@query("""WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_shipdate, count(*) AS n, round(avg(a + b * l_quantity), 3) AS predicted, round(avg(a + b * l_quantity), 3) AS inlined FROM lineitem, b GROUP BY l_shipdate""")
def sql_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all tasks, one model of them, and its scores by the table function and as a function of SQL."""
    sql.register(spark)
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    fit = "SELECT * FROM ml_fit(TABLE(SELECT * FROM ml_moments(TABLE(SELECT l_quantity, l_extendedprice FROM _lineitem), label => 'l_extendedprice', features => 'l_quantity')) WITH SINGLE PARTITION)"
    model = Model.from_json(spark.sql(fit).first()["model"])
    sql.publish(spark, "_price", model)
    sql.publish_table(spark, "_priced", model, spark.table("_lineitem").select("l_shipdate", "l_quantity").schema)
    return spark.sql("SELECT l_shipdate, count(*) AS n, round(avg(prediction), 3) AS predicted, round(avg(_price(l_quantity)), 3) AS inlined FROM _priced(TABLE(SELECT l_shipdate, l_quantity FROM _lineitem)) GROUP BY l_shipdate")


@query(oracle.single_linkage(3))
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cluster.agglomerative(_table(spark, sf_dir, "supplier"), ["s_acctbal"], 3, "single", most=300)
    return spark.createDataFrame([(k, round(c[0], 6)) for k, c in enumerate(sorted(m.state["centers"]))], "cluster int, center double")


@query("""WITH m AS (SELECT var_pop(l_quantity / 10) AS a, var_pop(l_tax * 100) AS c, covar_pop(l_quantity / 10, l_tax * 100) AS b FROM lineitem)
SELECT round(((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 5) AS first, round(((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)), 5) AS second FROM m""")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("a"), (F.col("l_tax") * 100).alias("b"))
    return spark.createDataFrame([tuple(round(v, 5) for v in decomp.pca(rows, ["a", "b"]).state["variance"])], "first double, second double")


@query(oracle.discriminants())
def lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_tax") * 100).alias("y"), "l_returnflag")
    m = decomp.lda(rows, ["x", "y"], "l_returnflag")
    return spark.createDataFrame([(k, *[round(c, 4) for c in v]) for k, v in enumerate(m.state["vectors"])], "k int, x double, y double")


@query(oracle.discriminants("SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS k FROM embeddings"))
def lda_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten classes."""
    rows = _dims(spark, sf_dir)
    m = decomp.lda(rows, DIMS[:2], "label")
    return spark.createDataFrame([(k, *[round(c, 4) for c in v]) for k, v in enumerate(m.state["vectors"])], "k int, x double, y double")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from a user's first event to the last; an event where the last one is a purchase."""
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    return rows.select(F.datediff("b", "a").cast("double").alias("t"), (F.col("e") == "purchase").cast("int").alias("d"))


KM = """WITH s AS (SELECT CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS DOUBLE) AS t,
CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 1 ELSE 0 END AS d FROM events GROUP BY user_id),
g AS (SELECT t, count(*) AS n, sum(d) AS d FROM s GROUP BY t),
r AS (SELECT t, sum(n) OVER (ORDER BY t DESC) AS n, d FROM g),
c AS (SELECT t, n, d, CASE WHEN sum(CASE WHEN n = d THEN 1 ELSE 0 END) OVER (ORDER BY t) > 0 THEN 0 ELSE exp(sum(CASE WHEN n > d THEN ln((n - d) / n) ELSE 0 END) OVER (ORDER BY t)) END AS s FROM r WHERE d > 0) """


@query(KM + "SELECT t AS time, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(s, 8) AS survival FROM c")
def km_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.kaplan_meier(_spans(spark, sf_dir), "t", "d").withColumn("survival", F.round("survival", 8))


@query(KM + "SELECT coalesce(min(CASE WHEN s <= 0.5 + 1e-12 THEN t END), max(t), 0) AS median_time FROM c")
def km_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.median_survival(survival.kaplan_meier(_spans(spark, sf_dir), "t", "d"))


@query(oracle.cox(5))
def cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.avg("value").alias("v"), F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    rows = rows.select((F.datediff("b", "a") + 1.0).alias("t"), (F.col("e") == "purchase").cast("int").alias("d"), (F.col("v") / 100).alias("x"))
    return spark.createDataFrame([(round(glm.cox(rows, "t", "d", ["x"], epochs=5).state["coefficients"][0], 8),)], "b1 double")


DAILY = "WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) / 1000 AS y FROM events GROUP BY 1), "


@query(DAILY + """z AS (SELECT day, y - lag(y) OVER (ORDER BY day) AS y FROM d), l AS (SELECT y, lag(y) OVER (ORDER BY day) AS x FROM z WHERE y IS NOT NULL)
SELECT round(regr_slope(y, x), 6) AS phi, round(regr_intercept(y, x), 6) AS constant FROM l""")
def arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.sum("value") / 1000).alias("y"))
    m = tseries.arima_fit(rows, "day", "y", 1, 1, 0)
    return spark.createDataFrame([(round(m["phi"][0], 6), round(m["constant"], 6))], "phi double, constant double")


@query("""WITH s AS (SELECT event_id, value AS y FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
l AS (SELECT y, lag(y) OVER (ORDER BY event_id, y) AS a, lag(y, 2) OVER (ORDER BY event_id, y) AS b FROM s),
m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM l WHERE b IS NOT NULL),
p AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS phi1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS phi2 FROM m)
SELECT round(phi1, 7) AS phi1, round(phi2, 7) AS phi2, round(my - phi1 * ma - phi2 * mb, 5) AS constant FROM p""")
def arima_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tseries.arima_by(_table(spark, sf_dir, "events"), [], "event_id", "value", 2, 0, 0)
    return m.select(*[F.round(F.col("phi")[i], 7).alias(f"phi{i + 1}") for i in range(2)], F.round("constant", 5).alias("constant"))


@query("""WITH s AS (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
d AS (SELECT event_type, event_id, value, value - lag(value) OVER w AS z FROM s WINDOW w AS (PARTITION BY event_type ORDER BY event_id, value)),
l AS (SELECT event_type, event_id, value, z, lag(z) OVER w AS a FROM d WINDOW w AS (PARTITION BY event_type ORDER BY event_id, value))
SELECT event_type, count(*) AS n_samples, round(regr_slope(z, a), 7) AS phi, round(regr_intercept(z, a), 5) AS constant, arg_max(value, event_id) AS last FROM l GROUP BY event_type""")
def arima_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tseries.arima_by(_table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 1, 1, 0)
    return m.select("event_type", "n_samples", F.round(F.col("phi")[0], 7).alias("phi"), F.round("constant", 5).alias("constant"), F.element_at("tail", -1).alias("last"))


MARK = "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"


@query(f"""WITH r AS (SELECT {MARK} = 1 AS y, l_extendedprice / 60000 > 0.5 AS p FROM lineitem),
c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn FROM r)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM c""")
def metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_extendedprice") / 60000).alias("p"))
    out = metrics.binary(rows, "y", "p")
    return out.select("tp", "fp", "tn", "fn", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""WITH r AS (SELECT {MARK} AS y, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS r FROM lineitem)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS roc_auc FROM r""")
def metrics_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("y"), F.col("l_extendedprice").alias("p"))
    return metrics.roc_auc(rows, "y", "p").select(F.round("roc_auc", 8).alias("roc_auc"))


@query("""SELECT count(*) AS n, round(avg(g * g), 6) AS mse, round(sqrt(avg(g * g)), 6) AS rmse, round(avg(abs(g)), 6) AS mae, round(1 - avg(g * g) / var_pop(y), 6) AS r2
FROM (SELECT l_extendedprice / 1000 AS y, l_extendedprice / 1000 - l_quantity AS g FROM lineitem)""")
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity")
    return metrics.regression(rows, "y", "l_quantity").select("n", *[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "r2")])


@query("""WITH d AS (SELECT p_partkey % 4 AS fold, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
b AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d JOIN (SELECT DISTINCT fold FROM d) f ON d.fold <> f.fold GROUP BY f.fold)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS samples, round(avg((y - a - b * x) * (y - a - b * x)), 3) AS mse,
round(1 - avg((y - a - b * x) * (y - a - b * x)) / var_pop(y), 6) AS r2 FROM d JOIN b USING (fold) GROUP BY fold""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.cross_validate(_table(spark, sf_dir, "part"), "linear_regression", ["p_size"], "p_retailprice", "p_partkey", 4)
    return out.select("fold", "samples", F.round("mse", 3).alias("mse"), F.round("r2", 6).alias("r2"))


@query(oracle.comparison())
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.compare(_table(spark, sf_dir, "part"), ["p_size"], "p_retailprice", ["linear_regression", "lasso_regression", "decision_tree"], params={"decision_tree": {"max_depth": 2}})[0].withColumn("r_squared", F.round("r_squared", 6)).withColumn("mse", F.round("mse", 3))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of events of every user and day."""
    return _table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("tid"), F.col("event_type").alias("item")).distinct()


ITEMS = """WITH b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type AS item FROM events),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, day FROM b)),
f AS (SELECT item AS items, 1 AS size, count(*) AS n FROM b GROUP BY item
UNION ALL SELECT a.item || ',' || c.item, 2, count(*) FROM b a JOIN b c USING (user_id, day) WHERE a.item < c.item GROUP BY 1
UNION ALL SELECT a.item || ',' || c.item || ',' || d.item, 3, count(*) FROM b a JOIN b c USING (user_id, day) JOIN b d USING (user_id, day) WHERE a.item < c.item AND c.item < d.item GROUP BY 1),
s AS (SELECT f.* FROM f, n WHERE f.n >= ceil(0.05 * n.n - 1e-9)) """


@query(ITEMS + "SELECT items, CAST(size AS INTEGER) AS size, n FROM s")
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = mining.frequent_itemsets(_baskets(spark, sf_dir), 0.05, 3)
    return found.select(F.array_join("items", ",").alias("items"), "size", "n")


@query(ITEMS + """, p AS (SELECT items, n, string_split(items, ',') AS x FROM s),
r AS (SELECT a.items AS antecedent, c.items AS consequent, b.n AS nb, a.n AS na, c.n AS nc FROM p b JOIN p a ON len(list_intersect(a.x, b.x)) = len(a.x) AND len(a.x) < len(b.x)
JOIN p c ON len(list_intersect(c.x, b.x)) = len(c.x) AND len(list_intersect(c.x, a.x)) = 0 AND len(c.x) = len(b.x) - len(a.x))
SELECT antecedent, consequent, round(nb / n.n, 8) AS support, round(nb / na, 8) AS confidence, round(nb / na * n.n / nc, 8) AS lift FROM r, n WHERE nb / na >= 0.3 - 1e-12""")
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mining.rules(*mining.frequent_itemsets(_baskets(spark, sf_dir), 0.05, 3), 0.3)
    return out.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), *[F.round(c, 8).alias(c) for c in ("support", "confidence", "lift")])


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS row_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, q ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) DESC, vec_id LIMIT 10""")
def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    q = rows.orderBy("vec_id").select("embedding").first()[0]
    return vectors.similar(rows, q, 10, -1.0, "vec_id").select("row_id", F.round("score", 4).alias("score"))


@query("SELECT count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS floats, CAST(4 * sum(len(embedding)) AS BIGINT) AS bytes FROM embeddings WHERE embedding IS NOT NULL")
def blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("embedding", vectors.pack(F.col("embedding")).alias("raw"))
    same = rows.where(vectors.unpack(F.col("raw")) == F.col("embedding"))
    return same.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).cast("long").alias("floats"), F.sum(F.length("raw")).cast("long").alias("bytes"))


@query("""WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality ORDER BY n, quality LIMIT 1)
SELECT CAST(quality AS INTEGER) AS minority, 2 * n AS synthetic FROM c""")
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    made = resample.smote(rows, ["n_chars"], "quality", "doc_id", 5, 2.0)
    return made.groupBy(F.col("quality").alias("minority")).agg(F.count(F.lit(1)).alias("synthetic"))


@query("""WITH b AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part)
SELECT p_partkey, round((2 * (a + b * p_size) + (SELECT avg(p_retailprice) FROM part)) / 3, 3) AS prediction FROM part, b""")
def voting_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    m = linear.linear(rows, ["p_size"], "p_retailprice")
    flat = linear.lasso(rows, ["p_size"], "p_retailprice", penalty=1e9)
    return resample.vote([m, flat, m], rows, "mean").select("p_partkey", F.round("prediction", 3).alias("prediction"))


@query("""SELECT c_mktsegment AS label, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label_index, n FROM
(SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)""")
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels = encode_labels(_table(spark, sf_dir, "customer"), "c_mktsegment")
    return rows.where("label_index is not null").groupBy(decode_labels(F.col("label_index"), labels).alias("label"), "label_index").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size < 25.5 THEN CASE WHEN p_retailprice < 1000 THEN 1.5 ELSE 2.5 END ELSE 3.5 END
+ CASE WHEN p_size < 10 THEN -1.0 ELSE 0.25 END + 0.5 AS DOUBLE) AS prediction FROM part""")
def boosted_json_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = '{"left_children": [1, 3, -1, -1, -1], "right_children": [2, 4, -1, -1, -1], "split_indices": [0, 1, 0, 0, 0], "split_conditions": [25.5, 1000, 3.5, 1.5, 2.5], "default_left": [0, 0, 0, 0, 0]}'
    two = '{"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [10, -1, 0.25], "default_left": [0, 0, 0]}'
    text = '{"learner": {"objective": {"name": "reg:squarederror"}, "learner_model_param": {"base_score": "5E-1", "num_feature": "2", "num_class": "0"}, "gradient_booster": {"model": {"trees": [%s, %s], "tree_info": [0, 0]}}}}' % (one, two)
    return boosted_json.parse(text, ["p_size", "p_retailprice"]).transform(_table(spark, sf_dir, "part")).select("p_partkey", "prediction")


@query("SELECT * FROM (VALUES (1, 'most_recent', TRUE), (2, 'best_score', TRUE), (1, 'rollback', TRUE)) t(version, strategy, success)")
def registry_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, of which the second fits better: deployed as the latest, by score, and rolled back."""
    rows = _table(spark, sf_dir, "lineitem")
    r = Registry(spark, shared_folder(spark, "registry"))
    r.save("price", linear.linear(rows, ["l_discount"], "l_extendedprice"))
    first = r.deploy("price").collect()
    r.save("price", linear.linear(rows, ["l_discount", "l_quantity"], "l_extendedprice"))
    out = first + r.deploy("price", "best_score").collect() + r.deploy("price", "rollback").collect()
    return spark.createDataFrame([(x["version"], x["strategy"], x["success"]) for x in out], "version int, strategy string, success boolean")


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
