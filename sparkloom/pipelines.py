"""The trainers as stages of Spark pipelines, which save and load with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from .model import Model, plain
from .operators.validate import train


class _Writer(MLWriter):
    def __init__(self, stage: Fitted | Learner):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=self.stage._told(self.sparkSession, path))


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind._from(told)
        stage._resetUid(told["uid"])
        return stage


class _Stage(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class Fitted(_Stage, Transformer):
    """A trained model as a pipeline stage."""

    def __init__(self, model: Model, out: str = "prediction"):
        super().__init__()
        self.model, self.out = model, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset, self.out)

    def _told(self, spark, path: str) -> dict:
        return {"model": self.model.at(spark, f"{path}/table").to_json(), "out": self.out}

    @staticmethod
    def _from(told: dict) -> Fitted:
        return Fitted(Model.from_json(told["model"]), told["out"])


class Learner(_Stage, Estimator):
    """Training by name as a pipeline stage: Learner(algorithm="ridge_regression", features=["x"], label="y", penalty=1.0)."""

    @keyword_only
    def __init__(self, *, algorithm: str, features: Sequence[str], label: str | None = None, out: str = "prediction", **params):
        super().__init__()
        self.algorithm, self.features, self.label, self.out, self.params_of = algorithm, list(features), label, out, params

    def _fit(self, dataset: DataFrame) -> Fitted:
        return Fitted(train(dataset, self.algorithm, self.features, self.label, **self.params_of), self.out)

    def _told(self, spark, path: str) -> dict:
        return {"algorithm": self.algorithm, "features": self.features, "label": self.label, "out": self.out, "trained_with": plain(self.params_of)}

    @staticmethod
    def _from(told: dict) -> Learner:
        return Learner(algorithm=told["algorithm"], features=told["features"], label=told["label"], out=told["out"], **told["trained_with"])
