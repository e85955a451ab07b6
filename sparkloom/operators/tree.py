"""Decision trees grown a level at a time, and what is made of them.

For a level, every row knows its open node; one aggregation gives the sums of each (node, feature, value), running sums
over the values give both sides of every split, and a grouped minimum picks each node's best: the lowest impurity, then
the first feature, then the lowest threshold. `bins` limits distinct values of a feature to quantiles; without it splits
are exact, and features of over FEW values are summed in ranges whose totals are carried over, so that no window holds
all values of a feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import checked, doubles, encode_labels, first_greatest, sigmoid
from ..model import Model, scorer
from ..plans.graph import cut
from ..stats import range_cuts, range_of, running_sums, with_next


def tree_column(tree: dict, x: list[Column], strict: bool = False) -> Column:
    """A tree {feature, threshold, left, right} or {value} as nested conditions; x <= threshold goes left, or x < it."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    c, t = x[tree["feature"]], F.lit(float(tree["threshold"]))
    left = (c < t) if strict else (c <= t)
    if strict and tree.get("default_left"):
        left = left | c.isNull() | F.isnan(c)
    return F.when(left, tree_column(tree["left"], x, strict)).otherwise(tree_column(tree["right"], x, strict))


@scorer("decision_tree")
def _tree(state: dict, x: list[Column]) -> Column:
    return tree_column(state["tree"], x)


@scorer("decision_tree_classifier")
def _tree_class(state: dict, x: list[Column]) -> Column:
    return tree_column(state["tree"], x)


#: Nodes of all trees up to which an ensemble is scored by an expression; larger ones go to Python in batches.
MOST_NODES = 1500


def nodes(tree: dict) -> int:
    return 1 if "value" in tree else 1 + nodes(tree["left"]) + nodes(tree["right"])


def flat(tree: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays: feature (-1 at leaves), threshold or value, and the left child, whose neighbour is the right."""
    feature, number, left, todo = [-1], [0.0], [0], [(0, tree)]
    while todo:
        k, node = todo.pop()
        if "value" in node:
            number[k] = float(node["value"])
            continue
        feature[k], number[k], left[k] = int(node["feature"]), float(node["threshold"]), len(feature)
        todo += [(left[k], node["left"]), (left[k] + 1, node["right"])]
        for many, blank in ((feature, -1), (number, 0.0), (left, 0)):
            many += [blank, blank]
    return np.array(feature), np.array(number), np.array(left)


def tree_values(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Rows by trees: the leaf value that each row reaches in each tree."""
    out = np.zeros((len(x), len(trees)))
    for j, (feature, number, left) in enumerate(trees):
        at = np.zeros(len(x), "i8")
        while (row := np.flatnonzero(feature[at] >= 0)).size:
            k = at[row]
            at[row] = left[k] + ~(x[row, feature[k]] <= number[k])
        out[:, j] = number[at]
    return out


def by_batch(trees: list[dict], x: list[Column], merge) -> Column:
    """`merge` (matrix of tree values -> numbers) of all trees' values, in Arrow batches."""
    arrays = [flat(t) for t in trees]

    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        return pa.array(np.concatenate([merge(tree_values(arrays, rows[k : k + 4096])) for k in range(0, len(rows), 4096)] or [np.zeros(0)]))

    return score(F.array(*x))


def _total(state: dict, x: list[Column], strict: bool) -> Column:
    rate, base = float(state["rate"]), float(state["base"])
    if not strict and sum(map(nodes, state["trees"])) > MOST_NODES:
        return by_batch(state["trees"], x, lambda v: base + rate * v.sum(1))
    out = F.lit(base)
    for t in state["trees"]:
        out = out + F.lit(rate) * tree_column(t, x, strict)
    return out


@scorer("random_forest")
def _forest(state: dict, x: list[Column]) -> Column:
    return by_batch(state["trees"], x, lambda v: v.mean(1))


@scorer("rf_classifier")
def _forest_votes(state: dict, x: list[Column]) -> Column:
    """The class that most trees vote for, the smallest of equals."""
    k = int(state["classes"])
    return by_batch(state["trees"], x, lambda v: np.stack([(v == c).sum(1) for c in range(k)], 1).argmax(1).astype("f8"))


@scorer("xgboost_multi")
def _boosted_classes(state: dict, x: list[Column]) -> Column:
    """The class of the highest score; round by round the trees of all classes stand in turn."""
    k, rate = int(state["classes"]), float(state["rate"])
    return by_batch(state["trees"], x, lambda v: (rate * v.reshape(len(v), -1, k).sum(1)).argmax(1).astype("f8"))


@scorer("xgboost_regression")
def _boosted(state: dict, x: list[Column]) -> Column:
    return _total(state, x, False)


@scorer("xgboost_binary")
def _boosted_binary(state: dict, x: list[Column]) -> Column:
    return sigmoid(_total(state, x, False))


@scorer("adaboost")
def _adaboost(state: dict, x: list[Column]) -> Column:
    total = F.lit(0.0)
    for s in state["stumps"]:
        sign = F.when(x[s["feature"]] <= F.lit(float(s["threshold"])), -1.0).otherwise(1.0)
        total = total + F.lit(float(s["alpha"] * s["polarity"])) * sign
    return F.when(total >= 0, F.lit(float(state["classes"][1]))).otherwise(F.lit(float(state["classes"][0])))


def binned(df: DataFrame, features: Sequence[str], bins: int | None) -> DataFrame:
    """Features raised to the nearest of about `bins` quantiles; a split x <= t at a quantile t parts both alike."""
    if not bins:
        return df
    cuts = df.select(*[F.percentile_approx(F.col(f).cast("double"), [k / bins for k in range(bins + 1)], 10_000).alias(f) for f in features]).first()

    def raised(f: str) -> Column:
        edges = F.array(*[F.lit(float(v)) for v in sorted(set(cuts[f]))])
        return F.coalesce(F.array_min(F.filter(edges, lambda e: e >= F.col(f).cast("double"))), F.element_at(edges, -1))

    return df.withColumns({f: raised(f) for f in features})


#: Distinct values of a feature up to which a node's sums run in one window.
FEW = 10_000


def value_ranges(df: DataFrame, features: Sequence[str]) -> list[list[float]] | None:
    """For features of over FEW values: where to part each feature's values into ranges."""
    counts = df.agg(*[F.approx_count_distinct(F.col(f).cast("double")).alias(f) for f in features]).first()
    return [range_cuts(df, f) for f in features] if max(counts) > FEW else None


def _by_ranges(at: DataFrame, sums: list[str], cuts: list[list[float]]) -> DataFrame:
    """node, f, v, the next value, and the sums up to v and of all values, by ranges of v."""
    which = F.lit(0)
    for k, c in enumerate(cuts):
        which = F.when(F.col("f") == k, range_of(F.col("v"), c)).otherwise(which)
    at = cut(at.withColumn("r", which))
    by = Window.partitionBy("node", "f").orderBy("r")  # at most as many rows as ranges
    before, all_of = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("node", "f")
    totals = at.groupBy("node", "f", "r").agg(F.min("v").alias("v0"), *[F.sum(s).alias(s) for s in sums])
    totals = totals.select("node", "f", "r", F.lead("v0").over(by).alias("after"), *[F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(f"b_{s}") for s in sums], *[F.sum(s).over(all_of).alias(f"a_{s}") for s in sums])
    inside = Window.partitionBy("node", "f", "r").orderBy("v")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("node", "f", "r", "v", F.lead("v").over(inside).alias("next"), *[F.sum(s).over(so_far).alias(f"l_{s}") for s in sums]).join(totals, ["node", "f", "r"])
    return at.select("node", "f", "v", F.coalesce("next", "after").alias("next"), *[(F.col(f"l_{s}") + F.col(f"b_{s}")).alias(f"l_{s}") for s in sums], *[f"a_{s}" for s in sums])


def _in_one_window(at: DataFrame, sums: list[str]) -> DataFrame:
    by = Window.partitionBy("node", "f").orderBy("v")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy("node", "f").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return at.select("node", "f", "v", F.lead("v").over(by).alias("next"), *[F.sum(s).over(so_far).alias(f"l_{s}") for s in sums], *[F.sum(s).over(all_of).alias(f"a_{s}") for s in sums])


def _best_splits(rows: DataFrame, features: Sequence[str], sums: list[str], impurity, min_leaf: float, middle: bool, cuts: list[list[float]] | None = None) -> list:
    """For each node the best split of `rows` (node, weight w, sums, features): impurity of both sides, feature, threshold."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)]))
    at = rows.select("node", "w", *sums, pairs.alias("p")).groupBy("node", "p.f", "p.v").agg(*[F.sum(s).alias(s) for s in ["w", *sums]])
    if cuts is None:
        at = _in_one_window(at, ["w", *sums])
    else:
        at = _by_ranges(at, ["w", *sums], cuts)
    at = at.where("next is not null")
    left = {s: F.col(f"l_{s}") for s in ["w", *sums]}
    right = {s: F.col(f"a_{s}") - F.col(f"l_{s}") for s in ["w", *sums]}
    at = at.where((left["w"] >= min_leaf) & (right["w"] >= min_leaf))
    # rounding: equal impurities reached by different sums tie
    score = F.round(impurity(left) + impurity(right), 9)
    best = F.min(F.struct(score.alias("score"), "f", ((F.col("v") + F.col("next")) / 2 if middle else F.col("v")).alias("t")))
    return at.groupBy("node").agg(best.alias("best")).select("node", "best.*").collect()


def _variance(s: dict) -> Column:
    return s["ss"] - s["s"] * s["s"] / s["w"]


def grow(df: DataFrame, features: Sequence[str], y: Column, max_depth: int, min_split: int, min_leaf: int, leaf_value=None, middle: bool = True, cuts: list[list[float]] | None = None) -> dict:
    """A regression tree on `y`. `leaf_value` maps a node's sums (w, s, ss and those of `extra` columns) to its value.

    Thresholds stand in the middle between two values, or at the lower one (for binned features)."""
    rows = df.select(*features, y.alias("_y"), *([F.col("_h")] if "_h" in df.columns else []), F.lit(1).alias("_node")).cache()
    try:
        value = leaf_value or (lambda r: r["s"] / r["w"])
        root: dict = {}
        open_ = {1: root}
        for depth in range(max_depth + 1):
            if not open_:
                break
            node = _node_of(root, doubles(features))
            level = rows.withColumn("node", node).where(F.col("node").isin([int(k) for k in open_])).select("node", *features, F.lit(1.0).alias("w"), F.col("_y").alias("s"), (F.col("_y") * F.col("_y")).alias("ss"), *([F.col("_h").alias("h")] if "_h" in rows.columns else []))
            whole = level.groupBy("node").agg(*[F.sum(s).alias(s) for s in ("w", "s", "ss", *(["h"] if "_h" in rows.columns else []))]).collect()
            stats = {r["node"]: r for r in whole}
            if not stats:
                raise ValueError("no rows to train on")
            can = [k for k, r in stats.items() if depth < max_depth and r["w"] >= min_split and r["w"] >= 2 * min_leaf and r["ss"] - r["s"] ** 2 / r["w"] > 1e-12]
            splits = {r["node"]: r for r in _best_splits(level.where(F.col("node").isin(can)), features, ["s", "ss"], _variance, min_leaf, middle, cuts)} if can else {}
            nxt = {}
            for k, place in open_.items():
                r, s = stats[k], splits.get(k)
                if s is None or s["score"] >= r["ss"] - r["s"] ** 2 / r["w"] - 1e-9:
                    place["value"] = float(value(r))
                else:
                    place |= {"feature": s["f"], "threshold": s["t"], "left": {}, "right": {}}
                    nxt[2 * k], nxt[2 * k + 1] = place["left"], place["right"]
            open_ = nxt
        return root
    finally:
        rows.unpersist()


def _node_of(tree: dict, x: list[Column], number: int = 1) -> Column:
    """Number of the node that a row is in; open nodes and leaves have no children."""
    if "feature" not in tree:
        return F.lit(number)
    return F.when(x[tree["feature"]] <= F.lit(float(tree["threshold"])), _node_of(tree["left"], x, 2 * number)).otherwise(_node_of(tree["right"], x, 2 * number + 1))


def decision_tree(df: DataFrame, features: Sequence[str], label: str, max_depth: int = 10, min_split: int = 5, min_leaf: int = 2, bins: int | None = None) -> Model:
    df = binned(checked(df, features, label), features, bins)
    return Model("decision_tree", list(features), {"tree": grow(df, features, F.col(label).cast("double"), max_depth, min_split, min_leaf, middle=not bins, cuts=None if bins else value_ranges(df, features))}, n_samples=df.count())


def gradient_boosting(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, rate: float = 0.1, max_depth: int = 6, subsample: float = 1.0, binary: bool = False, classes: int = 0, bins: int | None = None) -> Model:
    """Trees on residuals; for two classes (0 and 1) on p - y, with Newton leaves; for `classes` (0, 1, ...) a tree for
    each class and round on its probability minus its mark.

    Scores are kept as columns and checkpointed every few rounds, so that a round evaluates its own trees only. With
    `subsample` below 1 each round grows on the rows whose hash, with the round's number, falls under it.
    """
    if not 0 < subsample <= 1:
        raise ValueError("subsample must be above 0 and at most 1")
    many = int(classes) if classes > 2 else 1
    binary = binary or classes == 2
    df = binned(checked(df, features, label), features, bins)
    y, x, trees = F.col("_label"), doubles(features), []
    df = cut(df.select(*[c.alias(f) for c, f in zip(x, features, strict=True)], F.col(label).cast("double").alias("_label")))
    n, base, low, high = df.agg(F.count(F.lit(1)), F.avg(y), F.min(y), F.max(y)).first()
    if not n:
        raise ValueError("no rows to train on")
    if many > 1 and not (low >= 0 and high < many):
        raise ValueError(f"labels must be from 0 to {many - 1}")
    base = 0.0 if binary or many > 1 else base
    scores = [f"_s{k}" for k in range(many)]
    df = df.withColumns({s: F.lit(float(base)) for s in scores} | ({"_row": F.xxhash64(*features, "_label")} if subsample < 1 else {}))
    cuts = None if bins else value_ranges(df, features)
    newton = lambda r: -r["s"] / max(r["h"], 1e-12)
    for k in range(rounds):
        some = df.where(F.pmod(F.xxhash64("_row", F.lit(k)), F.lit(1 << 30)) < F.lit(subsample * (1 << 30))) if subsample < 1 else df
        if many > 1:
            top = F.greatest(*[F.col(s) for s in scores])
            parts = [F.exp(F.col(s) - top) for s in scores]
            whole = sum(parts[1:], parts[0])
            probabilities = [p / whole for p in parts]
            grown = [grow(some.withColumn("_h", p * (1 - p)), features, p - (y == c).cast("double"), max_depth, 5, 1, newton, not bins, cuts) for c, p in enumerate(probabilities)]
        elif binary:
            p = sigmoid(F.col("_s0"))
            grown = [grow(some.withColumn("_h", p * (1 - p)), features, p - y, max_depth, 5, 1, newton, not bins, cuts)]
        else:
            grown = [grow(some, features, y - F.col("_s0"), max_depth, 5, 1, middle=not bins, cuts=cuts)]
        trees += grown
        df = df.withColumns({s: F.col(s) + F.lit(rate) * tree_column(t, x) for s, t in zip(scores, grown, strict=True)})
        if k % 4 == 3:
            df = cut(df)
    name = "xgboost_multi" if many > 1 else "xgboost_binary" if binary else "xgboost_regression"
    model = Model(name, list(features), {"base": base, "rate": rate, "trees": trees} | ({"classes": many} if many > 1 else {}), n_samples=n)
    if many > 1:
        model.r_squared = model.extra["accuracy"] = df.agg(F.avg((first_greatest([F.col(s) for s in scores]) == y).cast("double"))).first()[0]
        return model
    p = sigmoid(F.col("_s0")) if binary else F.col("_s0")
    r = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var")).first()
    model.mse, model.r_squared = r["mse"], 1 - r["mse"] / r["var"] if r["var"] else None
    return model


def adaboost(df: DataFrame, features: Sequence[str], label: str, rounds: int = 50, bins: int | None = None) -> Model:
    """Exactly two classes; stumps by weighted error over all midpoints, features and both polarities."""
    df, classes = encode_labels(binned(checked(df, features, label), features, bins), label, "_k")
    if len(classes) != 2:
        raise ValueError(f"two classes are needed, not {len(classes)}")
    df = df.select(*features, (2 * F.col("_k") - 1).cast("double").alias("_y")).cache()
    try:
        n = df.count()
        cuts = [range_cuts(df.select(F.col(f).cast("double").alias("v")).distinct(), "v") for f in features]
        stumps: list[dict] = []
        for _ in range(rounds):
            margin = F.lit(0.0)
            for s in stumps:
                margin = margin + F.lit(s["alpha"] * s["polarity"]) * F.when(F.col(features[s["feature"]]).cast("double") <= F.lit(s["threshold"]), -1.0).otherwise(1.0)
            w = F.exp(-F.col("_y") * margin)
            # each feature's sums run over ranges of its values
            weighed = df.select(*features, w.alias("w"), (w * (F.col("_y") > 0).cast("double")).alias("up"))
            whole = weighed.agg(F.sum("w").alias("aw"), F.sum("up").alias("au"))
            at = None
            for k, (f, c) in enumerate(zip(features, cuts, strict=True)):
                one = weighed.groupBy(F.col(f).cast("double").alias("v")).agg(F.sum("w").alias("w"), F.sum("up").alias("up"))
                one = with_next(running_sums(one, "v", {"lw": F.col("w"), "lu": F.col("up")}, cuts=c), "v", c).select(F.lit(k).alias("f"), "v", "next", "lw", "lu")
                at = one if at is None else at.union(one)
            at = at.where("next is not null").crossJoin(F.broadcast(whole))
            # polarity 1: right of the threshold is the upper class
            error = (F.col("lu") + (F.col("aw") - F.col("au")) - (F.col("lw") - F.col("lu"))) / F.col("aw")
            both = F.explode(F.array(F.struct(F.round(error, 12).alias("e"), F.lit(0).alias("flip")), F.struct(F.round(1 - error, 12).alias("e"), F.lit(1).alias("flip"))))
            best = at.select("f", (F.col("v") if bins else (F.col("v") + F.col("next")) / 2).alias("t"), both.alias("b")).agg(F.min(F.struct("b.e", "f", "t", "b.flip")).alias("x")).first()["x"]
            if best is None:
                raise ValueError("features are constant")
            e = min(max(best["e"], 1e-10), 1 - 1e-10)
            stumps.append({"feature": best["f"], "threshold": best["t"], "polarity": -1.0 if best["flip"] else 1.0, "alpha": 0.5 * float(np.log((1 - e) / e)), "error": best["e"]})
        return Model("adaboost", list(features), {"stumps": stumps, "classes": [float(c) for c in classes]}, n_samples=n)
    finally:
        df.unpersist()


def _read(node) -> dict:
    """A fitted tree of Spark's as nested nodes."""
    if node.subtreeDepth() == 0:
        return {"value": float(node.prediction())}
    split = node.split()
    return {"feature": split.featureIndex(), "threshold": float(split.threshold()), "left": _read(node.leftChild()), "right": _read(node.rightChild())}


def random_forest(df: DataFrame, features: Sequence[str], label: str, classify: bool = False, trees: int = 100, max_depth: int = 10, min_leaf: int = 1, seed: int = 42) -> Model:
    """Spark's own forest: a third of the features per split to regress, their square root to classify.

    Features of up to 256 distinct values keep them all as split points; others have as many bins as the fullest of these,
    32 at least. The trees are read into the model, which can be saved and scores anywhere; a classifier has its labels.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    df = checked(df, features, label)
    counts = df.agg(*[F.count_distinct(F.col(f).cast("double")) for f in features]).first()
    bins = max([32, *(c for c in counts if c <= 256)])
    x = df.select(*[c.alias(f) for c, f in zip(doubles(features), features, strict=True)], F.col(label).alias("_y"))
    x = VectorAssembler(inputCols=list(features), outputCol="_features").transform(x).select("_features", "_y").cache()
    more = {"featuresCol": "_features", "labelCol": "_label", "numTrees": trees, "maxDepth": max_depth, "maxBins": bins, "minInstancesPerNode": min_leaf, "seed": seed}
    try:
        n = x.count()
        if not n:
            raise ValueError("no rows to train on")
        if classify:
            x, labels = encode_labels(x, "_y", "_label")
            fitted = RandomForestClassifier(featureSubsetStrategy="sqrt", **more).fit(x.withColumn("_label", F.col("_label").cast("double")))
            grown = [_read(t._call_java("rootNode")) for t in fitted.trees]
            return Model("rf_classifier", list(features), {"trees": grown, "classes": len(labels)}, n_samples=n, labels=labels)
        fitted = RandomForestRegressor(featureSubsetStrategy="onethird", **more).fit(x.withColumn("_label", F.col("_y").cast("double")))
        return Model("random_forest", list(features), {"trees": [_read(t._call_java("rootNode")) for t in fitted.trees]}, n_samples=n)
    finally:
        x.unpersist()
