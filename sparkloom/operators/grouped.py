"""A linear model for every group of a table, all in one pass.

One aggregation makes the moments of all groups (partial sums go before the shuffle, so that a group with a third of all
rows costs no more than another), batches of groups are solved together as arrays, and the models are a table, which
other rows are scored with by a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..frame import checked, doubles


def _solved(d: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.num_rows
            m = batch.column("moments").flatten().to_numpy(zero_copy_only=False).reshape(g, -1) if g else np.zeros((0, 1 + (d + 1) + (d + 1) * (d + 2) // 2))
            n, mean, upper = m[:, 0], m[:, 1 : d + 2], m[:, d + 2 :]
            cov = np.zeros((g, d + 1, d + 1))
            i, j = np.triu_indices(d + 1)
            cov[:, i, j] = cov[:, j, i] = upper
            a = cov[:, :d, :d] * n[:, None, None] + penalty * np.eye(d)
            scale = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-300))
            flat = (np.einsum("gii->gi", a) <= 0).any(1)
            unit = a / (scale[:, :, None] * scale[:, None, :])
            unit[flat] = np.eye(d)
            bad = flat | (np.linalg.cond(unit) > 1e12)
            unit[bad] = np.eye(d)
            beta = np.linalg.solve(unit, (cov[:, :d, d] * n[:, None] / scale)[:, :, None])[:, :, 0] / scale
            mse = np.maximum(cov[:, d, d] - 2 * (beta * cov[:, :d, d]).sum(1) + np.einsum("gi,gij,gj->g", beta, cov[:, :d, :d], beta), 0)
            varies = (cov[:, d, d] * n > 1e-10) & ~bad
            r2 = 1 - mse / np.where(cov[:, d, d] > 0, cov[:, d, d], 1)
            yield pa.RecordBatch.from_pydict({
                "group": batch.column("group"),
                "coefficients": pa.array([None if b else x for x, b in zip(beta.tolist(), bad, strict=True)], pa.list_(pa.float64())),
                "intercept": pa.array(mean[:, d] - (beta * mean[:, :d]).sum(1), pa.float64(), mask=bad),
                "r_squared": pa.array(r2, pa.float64(), mask=~varies),
                "mse": pa.array(mse, pa.float64(), mask=bad),
                "n_samples": pa.array(n.astype("i8")),
                "error": pa.array(["singular: features are constant or linearly dependent" if b else None for b in bad], pa.string()),
            })

    return run


def linear_by(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, penalty: float = 0.0) -> DataFrame:
    """A row per group: its keys, coefficients, intercept, r_squared, mse, n_samples, and the error of one that has no model.

    Least squares, or ridge regression with a penalty. Rows without a feature or label don't count; a null key is a group.
    """
    df, d = checked(df, features, label), len(features)
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    c = doubles([*features, label])
    found = [F.count(F.lit(1)).cast("double"), *[F.avg(x) for x in c], *[F.covar_pop(c[i], c[j]) for i in range(d + 1) for j in range(i, d + 1)]]
    moments = df.groupBy(*keys).agg(F.array(*found).alias("_moments"))
    rows = moments.select(F.struct(*keys).alias("group"), F.col("_moments").alias("moments"))
    kinds = rows.select("group").schema.add("coefficients", ArrayType(DoubleType())).add("intercept", "double").add("r_squared", "double").add("mse", "double").add("n_samples", "long").add("error", "string")
    return rows.mapInArrow(_solved(d, penalty), kinds).select("group.*", "coefficients", "intercept", "r_squared", "mse", "n_samples", "error")


def score_by(models: DataFrame, df: DataFrame, keys: Sequence[str], features: Sequence[str], out: str = "prediction") -> DataFrame:
    """`df` with the prediction of its group's model; null where the group has none or a feature lacks."""
    m = models.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("coefficients").alias("_beta"), F.col("intercept").alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = df.join(m, same, "left")
    total = F.col("_b")
    for i, x in enumerate(doubles(features)):
        total = total + F.col("_beta")[i] * x
    return joined.withColumn(out, total).drop("_beta", "_b", *[f"_key{i}" for i in range(len(keys))])
