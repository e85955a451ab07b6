"""Columns of features, checks on them, and expressions that models are scored by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def checked(df: DataFrame, features: Sequence[str], *more: str) -> DataFrame:
    """`df` without rows that lack a feature or label; an error for columns that aren't there."""
    names = [*features, *more]
    if not features:
        raise ValueError("no features")
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.dropna(subset=names)


def dot(weights: Sequence[float], columns: Sequence[Column], shift: float = 0.0) -> Column:
    """shift + w1 x1 + w2 x2 + ... as one expression."""
    out = F.lit(float(shift))
    for w, c in zip(weights, columns, strict=True):
        out = out + F.lit(float(w)) * c
    return out


def squared_distance(point: Sequence[float], columns: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for p, c in zip(point, columns, strict=True):
        out = out + (c - F.lit(float(p))) * (c - F.lit(float(p)))
    return out


def first_least(values: Sequence[Column]) -> Column:
    """Index of the least value, the first of equals."""
    return F.array_min(F.array(*[F.struct(v.alias("v"), F.lit(k).alias("k")) for k, v in enumerate(values)]))["k"]


def first_greatest(values: Sequence[Column]) -> Column:
    """Index of the greatest value, the first of equals."""
    return -F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-k).alias("k")) for k, v in enumerate(values)]))["k"]


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def encode_labels(df: DataFrame, label: str, out: str = "label_index") -> tuple[DataFrame, list]:
    """Number the distinct labels from 0 in their order. Classes are few: the list is checked to stay under 10,000."""
    labels = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(10_001).collect()]
    if len(labels) > 10_000:
        raise ValueError(f"{label} has more than 10,000 classes")
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    return df.withColumn(out, index.cast("int")), labels


def decode_labels(column: Column, labels: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (F.round(column) + 1).cast("int"))
