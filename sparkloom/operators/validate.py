"""Training by name, k-fold validation, and comparison of several algorithms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..frame import checked, encode_labels
from ..functions.metrics import regression
from ..model import Model
from . import bayes, cluster, decomp, glm, kernels, linear, margin, neighbors, network, survival, tree, tseries, tsne

#: Trainers that give a model: (rows, features, label, parameters). Defaults are the trainers' own.
TRAINERS: dict[str, Callable[..., Model]] = {
    "linear_regression": linear.linear,
    "ridge_regression": linear.linear,
    "lasso_regression": linear.lasso,
    "elastic_net": linear.elastic_net,
    "robust": linear.robust,
    "polynomial_regression": linear.polynomial,
    "logistic_regression": glm.logistic,
    "multilogistic": glm.multilogistic,
    "ordinal": glm.ordinal,
    "naive_bayes": bayes.naive_bayes,
    "decision_tree": tree.decision_tree,
    "xgboost_regression": tree.gradient_boosting,
    "xgboost_binary": lambda df, features, label, **p: tree.gradient_boosting(df, features, label, binary=True, **p),
    "adaboost": tree.adaboost,
    "random_forest": tree.random_forest,
    "rf_classifier": lambda df, features, label, **p: tree.random_forest(df, features, label, classify=True, **p),
    "knn_regressor": neighbors.knn,
    "knn_classifier": lambda df, features, label, **p: neighbors.knn(df, features, label, classify=True, **p),
    "arima": tseries.arima,
    "kaplan_meier": survival.survival_model,
    "cox": lambda df, features, label, time, **p: glm.cox(df, time, label, features, **p),
    "dbscan": lambda df, features, label=None, **p: cluster.dbscan_train(df, features, **p),
    "svm": kernels.svm,
    "svr": kernels.svr,
    "svm_features": margin.svm,
    "svr_features": margin.svr,
    "tsne": lambda df, features, label=None, **p: tsne.tsne_train(df, features, **p),
    "mlp_regressor": network.mlp_regressor,
    "lda": decomp.lda,
    "pca": lambda df, features, label=None, **p: decomp.pca(df, features, **p),
    "kmeans": lambda df, features, label=None, **p: cluster.kmeans(df, features, **p),
    "fuzzy_cmeans": lambda df, features, label=None, **p: cluster.fuzzy_cmeans(df, features, **p),
    "agglomerative": lambda df, features, label=None, **p: cluster.agglomerative(df, features, **p),
}

REGRESSION = ("linear_regression", "lasso_regression", "random_forest", "knn_regressor", "mlp_regressor")
CLASSIFICATION = ("logistic_regression", "rf_classifier", "knn_classifier", "naive_bayes")
#: Algorithms whose label is a class; text labels are numbered for them in their order.
OF_CLASSES = {"logistic_regression", "multilogistic", "ordinal", "naive_bayes", "xgboost_binary", "adaboost", "svm", "svm_features", "knn_classifier", "lda"}


def train(df: DataFrame, algorithm: str, features: Sequence[str], label: str | None = None, **params) -> Model:
    if algorithm not in TRAINERS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(sorted(TRAINERS))}")
    if label is None or not isinstance(df.schema[label].dataType, StringType) or algorithm not in OF_CLASSES:
        return TRAINERS[algorithm](df, features, label, **params)
    df, labels = encode_labels(df.where(F.col(label).isNotNull()), label, "_label_number")
    if algorithm == "xgboost_binary" and len(labels) > 2:
        params = {"classes": len(labels)} | params
    model = TRAINERS[algorithm](df, features, "_label_number", **params)
    model.labels = labels
    return model


def cross_validate(df: DataFrame, algorithm: str, features: Sequence[str], label: str, row_id: str, k: int = 5, **params) -> DataFrame:
    """Per fold (row_id modulo k): fold, samples, and mse and r2 of the rows held out."""
    df = checked(df, features, label, row_id).withColumn("_fold", F.pmod(F.col(row_id).cast("long"), F.lit(k)).cast("int")).cache()
    try:
        n = df.count()
        if not 2 <= k <= n:
            raise ValueError(f"k must be from 2 to {n}")
        out = []
        for fold in range(k):
            held = df.where(F.col("_fold") == fold)
            if held.isEmpty():
                continue
            model = train(df.where(F.col("_fold") != fold), algorithm, features, label, **params)
            r = regression(model.transform(held, "_p"), label, "_p").first()
            out.append((fold, r["n"], r["mse"], r["r2"]))
        return df.sparkSession.createDataFrame(out, "fold int, samples long, mse double, r2 double")
    finally:
        df.unpersist()


def compare(df: DataFrame, features: Sequence[str], label: str, algorithms: Sequence[str] | None = None, task: str = "regression", name: str = "experiment", params: dict[str, dict] | None = None, together: int = 3) -> tuple[DataFrame, dict[str, Model]]:
    """A row per algorithm (with the error of one that fails), and the models by name. Trainings run side by side, as
    many as `together`."""
    if isinstance(checked(df, features, label).schema[label].dataType, StringType):
        raise ValueError("labels must be numbers to compare errors")
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task {task!r}")

    def one(a: str) -> tuple[tuple, Model | None]:
        key = f"{name}_{a}"
        try:
            m = train(df, a, features, label, **(params or {}).get(a, {}))
            r = regression(m.transform(checked(df, features, label), "_p"), label, "_p").first()
            return (key, a, float(r["r2"]), float(r["mse"]), int(r["n"]), len(features), None), m
        except (ValueError, PySparkException) as e:
            return (key, a, None, None, 0, len(features), str(e)), None

    with ThreadPoolExecutor(max(1, together)) as pool:
        done = list(pool.map(one, algorithms or (REGRESSION if task == "regression" else CLASSIFICATION)))
    rows, models = [row for row, _ in done], {row[0]: m for row, m in done if m is not None}
    return df.sparkSession.createDataFrame(rows, "model_name string, algorithm string, r_squared double, mse double, n_samples long, n_features int, error string"), models
