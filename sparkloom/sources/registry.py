"""Versioned models, deployments, data snapshots and experiment runs, kept as Parquet tables under one path.

Tables are only appended to: a version, a deployment, a snapshot or a metric is a new row, and the state is the latest
row of its key. Rows are small; models are JSON text.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..model import Model

TABLES = {
    "models": "name string, version int, algorithm string, n_samples long, n_features int, r_squared double, mse double, body string, status string, at long",
    "deployments": "model_name string, version int, strategy string, at long",
    "snapshots": "model_name string, relation_name string, n_features int, n_samples long, target_column string, feature_columns string, data_hash string, at long",
    "experiments": "name string, task string, at long",
    "datasets": "name string, path string, at long",
    "runs": "run_id string, experiment string, run_name string, model_name string, status string, at long",
    "metrics": "run_id string, key string, value double, step int, at long",
    "params": "run_id string, key string, value string, at long",
}


def data_hash(df: DataFrame, columns: list[str]) -> str:
    """A hash of a table's rows whatever their order: the count and the sum of row hashes, in decimals that hold any sum."""
    r = df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return f"{r[0]:x}-{int(r[1] or 0) % (1 << 64):016x}"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], TABLES[name])

    def _add(self, name: str, *row) -> None:
        self.spark.createDataFrame([(*row, time.time_ns())], TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def save(self, name: str, model: Model) -> int:
        """Store a new version, with a copy of its table if it has one; its number."""
        last = self._rows("models").where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        model = model.at(self.spark, f"{self.path}/tables/{name}-{version}-{time.time_ns():x}")
        self._add("models", name, version, model.algorithm, int(model.n_samples or 0), len(model.features), model.r_squared, model.mse, model.to_json(), "trained")
        return version

    def keep_data(self, name: str, df: DataFrame) -> None:
        """Keep rows under a name, to be scored or trained on again."""
        path = f"{self.path}/data/{name}-{time.time_ns():x}"
        df.write.parquet(path)
        self._add("datasets", name, path)

    def data(self, name: str) -> DataFrame:
        """The rows last kept under a name."""
        row = self._rows("datasets").where(F.col("name") == name).orderBy(F.desc("at")).limit(1).collect()
        if not row:
            raise KeyError(f"no data {name!r}")
        return self.spark.read.parquet(row[0]["path"])

    def publish(self, prefix: str = "ml_") -> None:
        """Make models and all tables readable in SQL, as temporary views: ml_list_models, ml_deployments, ..."""
        self.list_models().createOrReplaceTempView(f"{prefix}list_models")
        for name in TABLES:
            self._rows(name).createOrReplaceTempView(f"{prefix}{name}")

    def score(self, name: str, df: DataFrame | str, out: str = "prediction") -> DataFrame:
        """`df`, or the rows kept under that name, with the prediction of the deployed or latest version."""
        return self.get(name).transform(self.data(df) if isinstance(df, str) else df, out)

    def delete(self, name: str) -> None:
        """Mark all versions of a model as deleted."""
        for r in self._versions().where(F.col("name") == name).collect():
            self._add("models", name, r["version"], r["algorithm"], r["n_samples"], r["n_features"], r["r_squared"], r["mse"], "", "deleted")

    def _versions(self) -> DataFrame:
        latest = F.row_number().over(Window.partitionBy("name", "version").orderBy(F.desc("at")))
        return self._rows("models").withColumn("_k", latest).where("_k = 1 and status <> 'deleted'").drop("_k")

    def list_models(self) -> DataFrame:
        return self._versions().select("name", "version", "algorithm", "status", "r_squared", "mse", "n_samples", "n_features", F.timestamp_micros(F.floor(F.col("at") / 1000)).alias("created_at"))

    def get(self, name: str, version: int | None = None) -> Model:
        """A version; by default the deployed one, and else the latest."""
        if version is None:
            version = self.deployed(name)
        found = self._versions().where(F.col("name") == name)
        found = found.where(F.col("version") == version) if version is not None else found.orderBy(F.desc("version"))
        row = found.limit(1).collect()
        if not row:
            raise KeyError(f"no model {name!r}" + (f" of version {version}" if version is not None else ""))
        return Model.from_json(row[0]["body"])

    def deployed(self, name: str) -> int | None:
        row = self._rows("deployments").where(F.col("model_name") == name).orderBy(F.desc("at")).limit(1).collect()
        return row[0]["version"] if row else None

    def deploy(self, name: str, strategy: str = "most_recent", version: int | None = None) -> DataFrame:
        """Deploy the version given, the latest, the one of greatest r_squared, or (rollback) the one deployed before."""
        kinds = "model_name string, version int, algorithm string, strategy string, success boolean, error string"
        rows = self._versions().where(F.col("name") == name)
        error = None
        if strategy == "rollback":
            past = self._rows("deployments").where(F.col("model_name") == name).orderBy(F.desc("at")).limit(2).collect()
            version, error = (past[1]["version"], None) if len(past) > 1 else (None, "no deployment before")
        elif strategy == "best_score":
            best = rows.where("r_squared is not null").orderBy(F.desc("r_squared"), F.desc("version")).limit(1).collect()
            version, error = (best[0]["version"], None) if best else (None, "no model with a score")
        elif version is None:
            best = rows.orderBy(F.desc("version")).limit(1).collect()
            version, error = (best[0]["version"], None) if best else (None, "no such model")
        row = rows.where(F.col("version") == version).limit(1).collect() if version is not None else []
        if not row:
            return self.spark.createDataFrame([(name, version, None, strategy, False, error or "no such model")], kinds)
        self._add("deployments", name, version, strategy)
        return self.spark.createDataFrame([(name, version, row[0]["algorithm"], strategy, True, None)], kinds)

    def snapshot(self, model_name: str, relation: str, df: DataFrame, features: list[str], target: str) -> str:
        """Note which data a model was trained on; the data's hash."""
        found = data_hash(df, [*features, target])
        self._add("snapshots", model_name, relation, len(features), df.count(), target, json.dumps(features), found)
        return found

    def list_snapshots(self, model_name: str) -> DataFrame:
        return self._rows("snapshots").where(F.col("model_name") == model_name).orderBy("at").drop("at")

    def ensure_experiment(self, name: str, task: str = "regression") -> None:
        """Note an experiment; one that is there already keeps its name and takes the task."""
        self._add("experiments", name, task)

    def experiments(self) -> DataFrame:
        return self._rows("experiments").groupBy("name").agg(F.max_by("task", "at").alias("task"), F.min("at").alias("created_at"))

    def start_run(self, experiment: str, run_name: str, model_name: str = "") -> str:
        run_id = f"{experiment}-{time.time_ns():x}"
        self._add("runs", run_id, experiment, run_name, model_name, "running")
        return run_id

    def finish_run(self, run_id: str, status: str = "finished") -> None:
        r = self._rows("runs").where(F.col("run_id") == run_id).orderBy(F.desc("at")).first()
        if r is None:
            raise KeyError(f"no run {run_id!r}")
        self._add("runs", run_id, r["experiment"], r["run_name"], r["model_name"], status)

    def log_metric(self, run_id: str, key: str, value: float, step: int = 0) -> None:
        self._add("metrics", run_id, key, float(value), step)

    def log_param(self, run_id: str, key: str, value: str) -> None:
        self._add("params", run_id, key, str(value))

    def runs(self, experiment: str) -> DataFrame:
        """Each run's latest status."""
        latest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("at")))
        return self._rows("runs").where(F.col("experiment") == experiment).withColumn("_k", latest).where("_k = 1").drop("_k", "at")

    def metrics(self, run_id: str) -> DataFrame:
        return self._rows("metrics").where(F.col("run_id") == run_id).orderBy("at").drop("at")

    def params(self, run_id: str) -> DataFrame:
        return self._rows("params").where(F.col("run_id") == run_id).orderBy("at").drop("at")
