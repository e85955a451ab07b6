"""Distributed statistics that trainers start from: moments, exact order statistics, running sums in a global order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Row count (or weight), means, and the population covariance matrix of some columns."""

    n: float
    mean: np.ndarray
    cov: np.ndarray


def moments(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> Moments:
    """One aggregation; with weights two, the second about the weighted means."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    if weight is None:
        row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
        n, mean, cov = row[0], row[1 : d + 1], row[d + 1 :]
    else:
        row = df.agg(F.sum(weight), *[F.sum(weight * c) / F.sum(weight) for c in columns]).first()
        n, mean = row[0], row[1:]
        if n is not None:
            off = [c - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
            cov = df.agg(*[F.sum(weight * off[i] * off[j]) / F.sum(weight) for i, j in pairs]).first()
    if not n:
        raise ValueError("no rows to train on")
    out = np.zeros((d, d))
    for (i, j), c in zip(pairs, cov, strict=True):
        out[i, j] = out[j, i] = c
    return Moments(float(n), np.array(mean, "f8"), out)


def order_statistic(df: DataFrame, column: Column, place: int, few: int = 10_000, buckets: int = 1024) -> float:
    """The value at `place` (from 0) in ascending order, exactly.

    Equal-width counts narrow the range until few values are left; no sort of the whole column, and no task or driver
    holds more than `few` values or `buckets` counts, unless all that are left are equal.
    """
    values = df.select(column.cast("double").alias("v")).where("v is not null")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 0 <= place < n:
        raise ValueError(f"no place {place} among {n} values")
    while n > few and low < high:
        width = (high - low) / buckets
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(buckets - 1)) if width > 0 else F.lit(0)
        counts = values.where(F.col("v").between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["b"]):
            if place < r["n"]:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            place -= r["n"]
    if low == high:
        return low
    return sorted(r[0] for r in values.where(F.col("v").between(low, high)).collect())[place]


def range_cuts(df: DataFrame, order: str, buckets: int = 128) -> list[float]:
    """Values that part `order` into up to `buckets` ranges of about as many rows."""
    cuts = df.select(F.percentile_approx(F.col(order).cast("double"), [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    return sorted(set(cuts))


def range_of(x: Column, cuts: Sequence[float], low: int = 0) -> Column:
    """How many of the sorted cuts lie below x, found by halves: as many comparisons a row as the logarithm of the cuts."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x > F.lit(float(cuts[mid])), range_of(x, cuts[mid + 1 :], low + mid + 1)).otherwise(range_of(x, cuts[:mid], low))


def _ranged(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    return df.withColumn("_range", range_of(F.col(order).cast("double"), cuts))


def with_next(df: DataFrame, order: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """`df`, of one row per value of `order`, with the value that follows as `next` (null at the last).

    Windows run within a range; the last row of a range takes the first value of a later one.
    """
    parts = _ranged(df, order, range_cuts(df, order) if cuts is None else cuts)
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range")
    firsts = parts.groupBy("_range").agg(F.min(order).alias("_first")).select("_range", F.lead("_first").over(ahead).alias("_after"))
    inside = Window.partitionBy("_range").orderBy(order)
    out = parts.select("*", F.lead(order).over(inside).alias("next")).join(F.broadcast(firsts), "_range")
    return out.select(*df.columns, F.coalesce("next", "_after").alias("next"))


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, buckets: int = 128, cuts: Sequence[float] | None = None) -> DataFrame:
    """`df`, of one row per value of `order`, with running sums in that order.

    Rows are dealt into ranges of `order`; windows run within a range, and the totals of earlier ranges (at most
    `buckets` rows) are added.
    """
    parts = _ranged(df, order, range_cuts(df, order, buckets) if cuts is None else cuts)
    totals = parts.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    key = F.desc("_range") if descending else F.asc("_range")
    before = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.select("*", *[F.sum(c).over(inside).alias(k) for k, c in sums.items()]).join(F.broadcast(totals), "_range")
    return out.select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])
