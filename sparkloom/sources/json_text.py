"""Training data given as JSON text: an array of rows of numbers, and an array of numbers or texts for the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, features: str, target: str | None = None) -> DataFrame:
    """row_id, f0, f1, ... and, with a target, y (double, or text where the labels are texts).

    Rows of different widths, and a target of another length, are errors.
    """
    one = spark.createDataFrame([(features, target)], "features string, target string")
    strict = {"mode": "FAILFAST"}
    x = one.select(F.posexplode(F.from_json("features", "array<array<double>>", strict)).alias("row_id", "x"))
    n, low, high = x.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n or low < 1:
        raise ValueError("no rows")
    if low != high:
        raise ValueError("rows of different widths")
    if not x.where(F.exists("x", lambda v: v.isNull())).isEmpty():
        raise ValueError("rows must hold numbers only")
    out = x.select("row_id", *[F.col("x")[k].alias(f"f{k}") for k in range(low)])
    if target is None:
        return out
    texts = one.select(F.schema_of_json(F.lit(target))).first()[0].lower() == "array<string>"
    y = one.select(F.posexplode(F.from_json("target", "array<string>" if texts else "array<double>", strict)).alias("row_id", "y"))
    if y.count() != n:
        raise ValueError("features and target differ in length")
    return out.join(y, "row_id")
