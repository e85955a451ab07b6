"""Kaplan-Meier curves; proportional hazards are in glm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Model, scorer
from ..stats import running_sums


def kaplan_meier(df: DataFrame, time: str, event: str) -> DataFrame:
    """Per time with events: time, at_risk, events, survival. Rows are summed per distinct time first."""
    at = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(time).cast("double").alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    at = running_sums(at, "time", {"at_risk": F.col("n")}, descending=True).where("events > 0").select("time", "at_risk", "events")
    left = F.col("at_risk") - F.col("events")
    out = running_sums(at, "time", {"logs": F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(0.0), "zeros": (left <= 0).cast("int")})
    return out.select("time", "at_risk", "events", F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp("logs")).alias("survival"))


def median_survival(curve: DataFrame) -> DataFrame:
    """The first time at which half or fewer survive, else the last time with an event, else 0."""
    # a hair above one half counts as half: survival is a product of quotients
    low = F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time")))
    return curve.agg(F.coalesce(low, F.max("time"), F.lit(0.0)).alias("median_time"))


@scorer("kaplan_meier")
def _median(state: dict, x: list[Column]) -> Column:
    return F.lit(float(state["median"]))


def survival_model(df: DataFrame, features: Sequence[str], label: str) -> Model:
    """Of times (the one feature) and events (the label): every row is given the median survival time."""
    if len(features) != 1:
        raise ValueError("one feature, the time, is needed")
    median = median_survival(kaplan_meier(df, features[0], label)).first()[0]
    return Model("kaplan_meier", list(features), {"median": median}, n_samples=df.count())
