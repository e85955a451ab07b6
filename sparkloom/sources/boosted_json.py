"""Boosted-tree models in the JSON format that gradient-boosting libraries share: read into expressions, and written."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..frame import first_greatest, sigmoid
from ..model import Model, scorer
from ..operators.tree import tree_column

#: Fixed names of the format's objectives whose sum is the prediction.
RAW = ("reg:squarederror", "reg:squaredlogerror", "reg:absoluteerror", "reg:pseudohubererror")
LOGISTIC = ("binary:logistic", "reg:logistic")
SOFTMAX = ("multi:softprob", "multi:softmax")


def _nested(tree: dict, node: int = 0) -> dict:
    if tree["left_children"][node] < 0:
        return {"value": float(tree["split_conditions"][node])}
    return {
        "feature": int(tree["split_indices"][node]), "threshold": float(tree["split_conditions"][node]), "default_left": bool(tree["default_left"][node]),
        "left": _nested(tree, tree["left_children"][node]), "right": _nested(tree, tree["right_children"][node]),
    }


def parse(text: str, features: list[str] | None = None) -> Model:
    """The model in a JSON text; features are named f0, f1, ... if no names are given."""
    learner = json.loads(text)["learner"]
    objective = learner["objective"]["name"]
    if objective not in RAW + LOGISTIC + SOFTMAX:
        raise ValueError(f"objective {objective!r} isn't supported")
    p = learner["learner_model_param"]
    inner = learner["gradient_booster"]["model"]
    state = {"objective": objective, "base": float(str(p["base_score"]).strip("[]")), "classes": max(1, int(p.get("num_class", 0))), "trees": [_nested(t) for t in inner["trees"]], "group": [int(g) for g in inner.get("tree_info", [0] * len(inner["trees"]))]}
    names = features or [f"f{k}" for k in range(int(p["num_feature"]))]
    return Model("xgboost_regressor" if objective in RAW else "xgboost_classifier", names, state)


def load(spark: SparkSession, path: str, features: list[str] | None = None) -> Model:
    """The model in a file of any store that Spark reads."""
    return parse(spark.read.text(path, wholetext=True).first()[0], features)


@scorer("xgboost_regressor", "xgboost_classifier")
def _score(state: dict, x: list[Column]) -> Column:
    """The sum of leaves, its logistic, or the class of the greatest sum; a missing value goes the default way."""
    base = state["base"]
    if state["objective"] in LOGISTIC:  # the format keeps a probability
        base = float(np.log(base / (1 - base))) if 0 < base < 1 else 0.0
    sums = []
    for k in range(state["classes"]):
        total = F.lit(float(base))
        for tree, group in zip(state["trees"], state["group"], strict=True):
            if group == k:
                total = total + tree_column(tree, x, strict=True)
        sums.append(total)
    if state["objective"] in SOFTMAX:
        return first_greatest(sums).cast("double")
    return sigmoid(sums[0]) if state["objective"] in LOGISTIC else sums[0]


def dump(model: Model) -> str:
    """A boosted model of this library in the format. Its splits say <=, the format's <: thresholds move up by one float."""
    binary = model.algorithm == "xgboost_binary"
    if model.algorithm not in ("xgboost_regression", "xgboost_binary"):
        raise ValueError(f"{model.algorithm} has no such form")
    out = []
    for tree in model.state["trees"]:
        flat: dict[str, list] = {k: [] for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left")}

        def put(t: dict, flat=flat) -> int:
            at = len(flat["left_children"])
            leaf = "value" in t
            for k, v in zip(flat, (-1, -1, 0 if leaf else t["feature"], t["value"] * model.state["rate"] if leaf else float(np.nextafter(t["threshold"], np.inf)), 0), strict=True):
                flat[k].append(v)
            if not leaf:
                flat["left_children"][at] = put(t["left"])
                flat["right_children"][at] = put(t["right"])
            return at

        put(tree)
        out.append(flat)
    base = 1 / (1 + float(np.exp(-model.state["base"]))) if binary else model.state["base"]
    learner = {
        "objective": {"name": "binary:logistic" if binary else "reg:squarederror"},
        "learner_model_param": {"base_score": repr(base), "num_feature": str(len(model.features)), "num_class": "0"},
        "gradient_booster": {"name": "gbtree", "model": {"trees": out, "tree_info": [0] * len(out)}},
    }
    return json.dumps({"learner": learner})
