"""Synthetic minority rows and votes of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import checked
from ..model import Model
from ..stats import running_sums
from .neighbors import nearest


def minority(df: DataFrame, label: str) -> tuple[object, int, int]:
    """The rarest label (the smallest of equals), its rows, and all rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    r = counts.agg(F.min(F.struct("n", label)).alias("low"), F.sum("n").alias("all")).first()
    if r["low"] is None:
        raise ValueError("no rows to resample")
    return r["low"][label], r["low"]["n"], r["all"]


def smote(df: DataFrame, features: Sequence[str], label: str, row_id: str, k: int = 5, ratio: float = 1.0) -> DataFrame:
    """Synthetic rows (features and label), floor(ratio x minority rows) of them.

    Minority rows take turns in the order of their ids; each synthetic row lies between its source and one of the
    source's k nearest minority rows. Which one, and how far along, follow from a hash of id and turn, so results are
    the same on any cluster.
    """
    df = checked(df, features, label, row_id)
    low, n, _ = minority(df, label)
    if n < 2:
        raise ValueError("the minority class needs two rows or more")
    rows = df.where(F.col(label) == F.lit(low)).select(F.col(row_id).cast("long").alias("id"), *[F.col(f).cast("double").alias(f) for f in features])
    k, total = max(1, min(int(k), n - 1)), int(n * ratio)
    near = nearest(rows, rows, features, k, "id", "id", skip_self=True).select("qid", "rank", "tid")
    turns = running_sums(rows, "id", {"_turn": F.lit(1)})
    times = F.lit(total // n) + (F.col("_turn") <= total % n).cast("int")
    made = turns.withColumn("_times", times).where("_times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    made = made.select("*", (F.pmod(F.xxhash64("id", "_copy", F.lit("neighbour")), F.lit(k)) + 1).cast("int").alias("rank"), (F.pmod(F.xxhash64("id", "_copy", F.lit("place")), F.lit(1 << 52)) / float(1 << 52)).alias("_at"))
    other = rows.select(F.col("id").alias("tid"), *[F.col(f).alias(f"_{f}") for f in features])
    made = made.join(near.withColumnRenamed("qid", "id"), ["id", "rank"]).join(other, "tid")
    return made.select(*[(F.col(f) + F.col("_at") * (F.col(f"_{f}") - F.col(f))).alias(f) for f in features], F.lit(low).alias(label))


def vote(models: Sequence[Model], df: DataFrame, mode: str = "hard", out: str = "prediction") -> DataFrame:
    """`df` with `votes` and their result: the commonest rounded vote (the first model's of equals), or the mean."""
    if not models:
        raise ValueError("no models to ask")
    if mode not in ("hard", "majority", "mean", "average", "soft"):
        raise ValueError(f"unknown mode {mode!r}")
    given = df.columns
    for k, m in enumerate(models):
        df = m.transform(df, f"_vote{k}")
    df = df.select(*given, F.array(*[f"_vote{k}" for k in range(len(models))]).alias("votes"))
    if mode in ("mean", "average", "soft"):
        return df.withColumn(out, F.aggregate("votes", F.lit(0.0), lambda a, v: a + v) / len(models))
    whole = F.transform("votes", lambda v: F.round(v))
    scored = F.transform(whole, lambda v, i: F.struct(F.size(F.filter(whole, lambda u: u == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return df.withColumn(out, F.array_max(scored)["v"])
