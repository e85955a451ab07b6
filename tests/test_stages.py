"""Saved pipeline stages, votes of any model, and models that keep a table."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sparkloom.operators import linear, neighbors, resample
from sparkloom.pipelines import Learner
from sparkloom.sources.registry import Registry


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    return spark.createDataFrame([(k, *map(float, a), float(a[0] > 0)) for k, a in enumerate(x)], "id long, f0 double, f1 double, y double").cache()


def test_pipelines_save_and_load(spark, rows, tmp_path):
    for k, learner in enumerate((Learner(algorithm="ridge_regression", features=["f0", "f1"], label="y", penalty=2.0), Learner(algorithm="knn_classifier", features=["f0", "f1"], label="y", k=3, out="near"))):
        whole = Pipeline(stages=[learner])
        whole.write().overwrite().save(str(tmp_path / f"plan{k}"))
        again = Pipeline.load(str(tmp_path / f"plan{k}")).getStages()[0]
        assert (again.algorithm, again.features, again.label, again.out, again.params_of) == (learner.algorithm, learner.features, learner.label, learner.out, learner.params_of)
        fitted = whole.fit(rows)
        fitted.write().overwrite().save(str(tmp_path / f"model{k}"))
        back = PipelineModel.load(str(tmp_path / f"model{k}"))
        one, two = ({r["id"]: r[learner.out] for r in m.transform(rows).collect()} for m in (fitted, back))
        assert one == two and back.stages[0].uid == fitted.stages[0].uid


def test_votes_of_neighbours(spark, rows):
    models = [neighbors.knn(rows, ["f0", "f1"], "y", 3, classify=True), linear.linear(rows, ["f0"], "y"), neighbors.knn(rows, ["f0"], "y", 1)]
    out = resample.vote(models, rows, "mean").select("id", "votes", "prediction", "y").collect()
    assert len(out) == 120 and all(len(r.votes) == 3 and r.prediction == pytest.approx(sum(r.votes) / 3) for r in out)
    hard = resample.vote(models, rows)
    assert hard.columns == [*rows.columns, "votes", "prediction"] and hard.where("prediction = y").count() > 110


def test_registry_keeps_a_models_table(spark, rows, tmp_path):
    r = Registry(spark, str(tmp_path / "registry"))
    m = neighbors.knn(rows, ["f0", "f1"], "y", 1)
    r.save("near", m)
    kept = r.get("near")
    assert kept.state["table"] != m.state["table"] and kept.state["table"].startswith(str(tmp_path))
    assert kept.transform(rows).where(F.col("prediction") != F.col("y")).isEmpty()
