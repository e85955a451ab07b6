"""What every trained model is: a small state, its scores as expressions or batches, and its quality."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import decode_labels, doubles

#: Scores of each algorithm: (state, feature columns) -> prediction.
SCORERS: dict[str, Callable[[dict, list[Column]], Column]] = {}


#: Models whose scores need a join with a table instead: (model, rows, name of the prediction) -> rows.
JOINERS: dict[str, Callable[[Model, DataFrame, str], DataFrame]] = {}


def joiner(*names: str):
    def put(f):
        for n in names:
            JOINERS[n] = f
        return f

    return put


def scorer(*names: str):
    def put(f):
        for n in names:
            SCORERS[n] = f
        return f

    return put


def plain(x: Any) -> Any:
    """Numpy values as what JSON holds."""
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list | tuple) else x


@dataclass
class Model:
    algorithm: str
    features: Sequence[str]
    state: dict
    r_squared: float | None = None
    mse: float | None = None
    n_samples: int = 0
    labels: list | None = None
    extra: dict = field(default_factory=dict)

    def column(self) -> Column:
        """The prediction as an expression over the feature columns."""
        return SCORERS[self.algorithm](self.state, doubles(self.features)).cast("double")

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """`df` with the prediction. Where the score is an expression no action runs, and streams can be scored as well;
        models that keep a table (neighbours, layouts) join with it, and take tables only."""
        if missing := [n for n in self.features if n not in df.columns]:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        df = JOINERS[self.algorithm](self, df, out) if self.algorithm in JOINERS else df.withColumn(out, self.column())
        return df.withColumn(f"{out}_label", decode_labels(F.col(out), self.labels)) if self.labels else df

    def predict_one(self, df_like: DataFrame, values: Sequence[float]) -> float:
        if len(values) != len(self.features):
            raise ValueError(f"{len(values)} values for {len(self.features)} features")
        row = df_like.sparkSession.createDataFrame([tuple(map(float, values))], ", ".join(f"`{n}` double" for n in self.features))
        return self.transform(row).first()["prediction"]

    def summary(self, df_like: DataFrame, name: str = "model") -> DataFrame:
        kinds = "model_name string, algorithm string, r_squared double, mse double, n_samples long, n_features int"
        return df_like.sparkSession.createDataFrame([(name, self.algorithm, self.r_squared, self.mse, self.n_samples, len(self.features))], kinds)

    def at(self, spark: SparkSession, path: str) -> Model:
        """The model with its own table, if it has one, copied to `path`."""
        if "table" not in self.state:
            return self
        spark.read.parquet(self.state["table"]).write.parquet(path)
        return replace(self, state=self.state | {"table": path})

    def to_json(self) -> str:
        return json.dumps(plain({k: getattr(self, k) for k in ("algorithm", "features", "state", "r_squared", "mse", "n_samples", "labels", "extra")}))

    @staticmethod
    def from_json(text: str) -> Model:
        return Model(**json.loads(text))


def scored(model: Model, df: DataFrame, label: str) -> Model:
    """`model` with the training rows' mean squared error and share of variance explained."""
    y, p = F.col(label).cast("double"), model.column()
    r = df.agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var")).first()
    model.n_samples, model.mse = r["n"], r["mse"]
    model.r_squared = 1 - r["mse"] / r["var"] if r["var"] and r["var"] * r["n"] > 1e-10 else None
    return model
