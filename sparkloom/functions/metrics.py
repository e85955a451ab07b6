"""Quality of predictions, as aggregations that give one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stats import running_sums


def _pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select(F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).dropna()


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, mse, rmse, mae, r2; without any spread of the actual values r2 is 1 for exact predictions and -inf otherwise."""
    gap = F.col("y") - F.col("p")
    out = _pairs(df, actual, predicted).agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop("y").alias("var"))
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(float("-inf"))
    return out.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("var") == 0, flat).otherwise(1 - F.col("mse") / F.nullif("var", F.lit(0.0))).alias("r2"))


def binary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1. Both sides count as 1 above one half; quotients of nothing are 0."""
    y, p = F.col("y") > 0.5, F.col("p") > 0.5
    out = _pairs(df, actual, predicted).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select("tp", "fp", "tn", "fn", part(tp + tn, tp + fp + tn + fn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """roc_auc: the chance that a positive row scores above a negative one, ties counting half; null with one class only.

    Rows are summed per distinct score first, and negatives below a score come from running sums over ranges of scores,
    so no task sorts all rows.
    """
    up = (F.col("y") > 0.5).cast("long")
    at = _pairs(df, actual, predicted).groupBy("p").agg(F.sum(up).alias("pos"), F.sum(1 - up).alias("neg"))
    at = running_sums(at, "p", {"below": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return at.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def evaluate(df: DataFrame, actual: str, predicted: str, task: str = "auto") -> DataFrame:
    """The binary metrics with roc_auc, or the regression ones; `auto` takes values that are all 0 or 1 as binary."""
    if task not in ("auto", "binary", "regression"):
        raise ValueError(f"unknown task {task!r}")
    n, marks = _pairs(df, actual, predicted).agg(F.count(F.lit(1)), F.bool_and(F.col("y").isin(0.0, 1.0))).first()
    if not n:
        raise ValueError("no rows to evaluate")
    if task == "binary" or task == "auto" and marks:
        return binary(df, actual, predicted).crossJoin(roc_auc(df, actual, predicted))  # one row each
    return regression(df, actual, predicted)
