"""Training, scoring and rules from SQL: table functions over TABLE arguments, and models as SQL functions.

    sql.register(spark)
    spark.sql("SELECT * FROM ml_train(TABLE(parts) PARTITION BY brand, label => 'price', features => 'size', keys => 'brand')")

A table function sees the rows of one partition at a time and keeps sums, not rows: ml_train gives one model per partition
of PARTITION BY. Over a table without keys, ml_moments gives sums per task, and ml_fit makes one model of them:

    SELECT * FROM ml_fit(TABLE(SELECT * FROM ml_moments(TABLE(parts), label => 'price', features => 'size')) WITH SINGLE PARTITION)

ml_predict adds `prediction` to every row of any table by a model's JSON, row by row; publish_table() makes a table function
of a model for tables of given columns, which does so in Arrow batches, as ml_moments takes its sums. publish() makes a
function of a model, which Catalyst folds into the query. ml_assoc_rules keeps the baskets of its partition.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, NumericType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .model import Model
from .operators.linear import solve
from .stats import Moments

#: Rows that are turned into sums at once.
CHUNK = 4096
FITTED = [StructField("coefficients", ArrayType(DoubleType())), StructField("intercept", DoubleType()), StructField("r_squared", DoubleType()), StructField("mse", DoubleType()), StructField("n_samples", LongType()), StructField("model", StringType())]


def _names(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _checked(table: AnalyzeArgument, label: AnalyzeArgument, features: AnalyzeArgument) -> list[str]:
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    names = [*_names(features.value), label.value]
    if len(names) < 2:
        raise ValueError("name one feature or more, and a label")
    for n in names:
        if n not in kinds:
            raise ValueError(f"no such column: {n}")
        if not isinstance(kinds[n], NumericType):
            raise ValueError(f"{n} is not a number")
    return names


class _Sums:
    """Count, means and products about the means of some columns, a chunk at a time."""

    def __init__(self):
        self.n, self.mean, self.products, self.wait = 0, None, None, []

    def add(self, values: list) -> None:
        if all(v is not None for v in values):
            self.wait.append([float(v) for v in values])
            if len(self.wait) >= CHUNK:
                self.fold()

    def fold(self) -> None:
        x, self.wait = np.array(self.wait, "f8"), []
        self.block(x)

    def block(self, x: np.ndarray) -> None:
        if len(x):
            m = x.mean(0)
            self.merge(len(x), m, (x - m).T @ (x - m))

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if not self.n:
            self.n, self.mean, self.products = n, mean, products
            return
        gap, total = mean - self.mean, self.n + n
        self.products = self.products + products + np.outer(gap, gap) * (self.n * n / total)
        self.mean, self.n = self.mean + gap * (n / total), total

    def fitted(self, names: list[str], penalty: float) -> tuple:
        cov = self.products / self.n
        beta, b = solve(Moments(float(self.n), self.mean, cov), penalty)
        mse = float(max(cov[-1, -1] - 2 * beta @ cov[:-1, -1] + beta @ cov[:-1, :-1] @ beta, 0.0))
        r2 = float(1 - mse / cov[-1, -1]) if cov[-1, -1] * self.n > 1e-10 else None
        model = Model("ridge_regression" if penalty else "linear_regression", names[:-1], {"coefficients": beta.tolist(), "intercept": b}, r2, mse, int(self.n))
        return beta.tolist(), b, r2, mse, int(self.n), model.to_json()


class Train:
    """One linear or ridge model per partition; `keys` are columns of the partition to give back with it."""

    @staticmethod
    def analyze(table: AnalyzeArgument, label: AnalyzeArgument, features: AnalyzeArgument, penalty: AnalyzeArgument | None = None, keys: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(table, label, features)
        kinds = {f.name: f for f in table.dataType.fields}
        given = _names(keys.value if keys else None)
        if missing := [k for k in given if k not in kinds]:
            raise ValueError(f"no such column: {missing[0]}")
        return AnalyzeResult(StructType([*[kinds[k] for k in given], *FITTED]))

    def __init__(self):
        self.sums, self.told = _Sums(), None

    def eval(self, table: Row, label: str, features: str, penalty: float = 0.0, keys: str = "") -> Iterator[tuple]:
        names = [*_names(features), label]
        if self.told is None:
            self.told = [table[k] for k in _names(keys)], names, float(penalty or 0.0)
        self.sums.add([table[n] for n in names])
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        self.sums.fold()
        if self.told is not None and self.sums.n:
            keys, names, penalty = self.told
            try:
                yield (*keys, *self.sums.fitted(names, penalty))
            except ValueError:  # a group without a model still counts
                yield (*keys, None, None, None, None, int(self.sums.n), None)


def _numbers(batch: pa.RecordBatch, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of a batch as doubles, and which rows have no null in them."""
    out, whole = [], np.ones(len(batch), bool)
    for n in names:
        if n not in batch.schema.names:
            raise ValueError(f"no such column: {n}")
        column, kind = batch.column(n), batch.schema.field(n).type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind)):
            raise ValueError(f"{n} is not a number")
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
        out.append(pc.fill_null(pc.cast(column, pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False))
    return out, whole


class TaskMoments:
    """Sums of the rows that a task sees, in Arrow batches, to be put together by ml_fit."""

    kinds = "names string, n long, mean array<double>, products array<double>"

    def __init__(self):
        self.sums, self.names = _Sums(), None

    def eval(self, table: pa.RecordBatch, label: pa.Array, features: pa.Array) -> Iterator[pa.Table]:
        if not isinstance(table, pa.RecordBatch):
            raise ValueError("the first argument must be a TABLE")
        if len(table):
            self.names = self.names or [*_names(features[0].as_py()), label[0].as_py()]
            if len(self.names) < 2:
                raise ValueError("name one feature or more, and a label")
            columns, whole = _numbers(table, self.names)
            self.sums.block(np.stack(columns, 1)[whole])
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.sums.n:
            doubles = pa.list_(pa.float64())
            yield pa.table({"names": [",".join(self.names)], "n": pa.array([int(self.sums.n)], pa.int64()), "mean": pa.array([self.sums.mean.tolist()], doubles), "products": pa.array([self.sums.products.ravel().tolist()], doubles)})


class Fit:
    """A model of the sums of all tasks."""

    @staticmethod
    def analyze(table: AnalyzeArgument, penalty: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or {"names", "n", "mean", "products"} - {f.name for f in table.dataType.fields}:
            raise ValueError("the argument must be a TABLE of ml_moments")
        return AnalyzeResult(StructType(FITTED))

    def __init__(self):
        self.sums, self.told = _Sums(), None

    def eval(self, table: Row, penalty: float = 0.0) -> Iterator[tuple]:
        self.told = table["names"].split(","), float(penalty or 0.0)
        mean = np.array(table["mean"], "f8")
        self.sums.merge(int(table["n"]), mean, np.array(table["products"], "f8").reshape(len(mean), len(mean)))
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if self.told:
            yield self.sums.fitted(*self.told)


def _scored(model: Model, table: StructType) -> StructType:
    """The columns of a table that a linear model has scored."""
    if "coefficients" not in model.state or "degree" in model.state:
        raise ValueError(f"table functions score linear models; publish() scores {model.algorithm}")
    if missing := [f for f in model.features if f not in table.names]:
        raise ValueError(f"no such column: {missing[0]}")
    return StructType([*table.fields, StructField("prediction", DoubleType())])


class Predict:
    """Every row of the table with the prediction of a linear model, null where a feature lacks."""

    @staticmethod
    def analyze(table: AnalyzeArgument, model: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a TABLE")
        return AnalyzeResult(_scored(Model.from_json(model.value), table.dataType))

    def __init__(self):
        self.model = None

    def eval(self, table: Row, model: str) -> Iterator[tuple]:
        if self.model is None:
            self.model = Model.from_json(model)
        x, s = [table[f] for f in self.model.features], self.model.state
        total = None
        if all(v is not None for v in x):
            total = s["intercept"] + sum(w * float(v) for w, v in zip(s["coefficients"], x, strict=True))
            total = 1 / (1 + math.exp(-max(min(total, 500.0), -500.0))) if "logistic" in self.model.algorithm else total
        yield (*table, total)


def itemsets(baskets: list[frozenset], least: int, max_size: int = 0) -> dict[tuple, int]:
    """Frequent itemsets of the baskets, level by level; a candidate has frequent subsets only."""
    rows: dict[str, list[int]] = {}
    for k, basket in enumerate(baskets):
        for item in basket:
            rows.setdefault(item, []).append(k)
    level = {(item,): np.array(r) for item, r in sorted(rows.items()) if len(r) >= least}
    out = {s: len(r) for s, r in level.items()}
    while level and (not max_size or len(next(iter(level))) < max_size):
        longer = {}
        heads = sorted(level)
        for i, a in enumerate(heads):
            for b in heads[i + 1 :]:
                if a[:-1] != b[:-1]:
                    break
                new = (*a, b[-1])
                if all(new[:k] + new[k + 1 :] in level for k in range(len(new) - 2)):
                    both = np.intersect1d(level[a], level[b], assume_unique=True)
                    if len(both) >= least:
                        longer[new] = both
        level = longer
        out |= {s: len(r) for s, r in level.items()}
    return out


class Rules:
    """Association rules of the baskets of a partition."""

    @staticmethod
    def analyze(table: AnalyzeArgument, items: AnalyzeArgument, min_support: AnalyzeArgument, min_confidence: AnalyzeArgument, max_size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or items.value not in table.dataType.names or not isinstance(table.dataType[items.value].dataType, ArrayType):
            raise ValueError("name an array column of a TABLE")
        names = ("support", "confidence", "lift")
        return AnalyzeResult(StructType([StructField("antecedent", ArrayType(StringType())), StructField("consequent", ArrayType(StringType())), *[StructField(n, DoubleType()) for n in names], StructField("n_both", LongType())]))

    def __init__(self):
        self.baskets, self.told = [], None

    def eval(self, table: Row, items: str, min_support: float, min_confidence: float, max_size: int = 0) -> Iterator[tuple]:
        self.told = float(min_support), float(min_confidence), int(max_size or 0)
        basket = frozenset(str(x) for x in table[items] or () if x is not None)
        if basket:
            self.baskets.append(basket)
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if not self.told or not self.baskets:
            return
        support, confidence, max_size = self.told
        n = len(self.baskets)
        found = itemsets(self.baskets, max(1, math.ceil(support * n - 1e-9)), max_size)
        for s, both in found.items():
            for size in range(1, len(s)):
                for a in combinations(s, size):
                    c = tuple(x for x in s if x not in a)
                    if both / found[a] >= confidence - 1e-12:
                        yield list(a), list(c), both / n, both / found[a], both / found[a] * n / found[c], both


FUNCTIONS = {"ml_train": Train, "ml_fit": Fit, "ml_predict": Predict, "ml_assoc_rules": Rules}


def register(spark: SparkSession) -> None:
    """The table functions, for the session's SQL."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
    spark.udtf.register("ml_moments", arrow_udtf(TaskMoments, returnType=TaskMoments.kinds))


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _tree_text(node: dict, names: list[str]) -> str:
    if "left" not in node:
        return _number(node["value"])
    return f"CASE WHEN {names[node['feature']]} <= {_number(node['threshold'])} THEN {_tree_text(node['left'], names)} ELSE {_tree_text(node['right'], names)} END"


def text_of(model: Model, names: list[str]) -> str:
    """A model's score as SQL over its features."""
    state = model.state
    if model.algorithm == "decision_tree":
        return _tree_text(state["tree"], names)
    if "coefficients" not in state:
        raise ValueError(f"{model.algorithm} has no form as a SQL expression")
    terms = [f"pow({x}, {k})" if k > 1 else x for x in names for k in range(1, state.get("degree", 1) + 1)]
    total = " + ".join([_number(state["intercept"]), *[f"{_number(w)} * {t}" for w, t in zip(state["coefficients"], terms, strict=True)]])
    return f"1 / (1 + exp(-greatest(least({total}, 500D), -500D)))" if model.algorithm == "logistic_regression" else total


def publish(spark: SparkSession, name: str, model: Model) -> None:
    """A model as a temporary SQL function of its features, in their order."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name of a function")
    args = [f"x{k}" for k in range(len(model.features))]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} DOUBLE' for a in args)}) RETURNS DOUBLE RETURN {text_of(model, args)}")


def publish_table(spark: SparkSession, name: str, model: Model, columns: StructType) -> None:
    """A linear model as a table function `name`(TABLE(...)) over tables of just these columns: as ml_predict, in Arrow
    batches. Spark's table functions over batches take no `analyze`, so that columns have to be known beforehand."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name of a function")
    kinds, features, weights, base, logistic = _scored(model, columns), list(model.features), list(model.state["coefficients"]), model.state["intercept"], "logistic" in model.algorithm

    class Scores:
        def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
            if not isinstance(table, pa.RecordBatch) or table.schema.names != kinds.names[:-1]:
                raise ValueError(f"the argument must be a TABLE of {', '.join(kinds.names[:-1])}")
            x, whole = _numbers(table, features)
            total = base + sum(w * v for w, v in zip(weights, x, strict=True))
            total = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if logistic else total
            yield pa.Table.from_arrays([*table.columns, pa.array(total, pa.float64(), mask=~whole)], kinds.names)

    spark.udtf.register(name, arrow_udtf(Scores, returnType=kinds))
