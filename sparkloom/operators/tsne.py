"""t-SNE in two dimensions, without comparing all pairs in any step.

Affinities are sparse: each row's nearest neighbours (found by the k-d split), weighted by a Gaussian whose width is
searched per row to meet the perplexity, and made symmetric by a grouped sum. A round moves all rows by two forces. Rows
attract their neighbours: a join along the sparse pairs and a grouped sum. All rows repel each other: their charges go to
the nodes of a grid by local interpolation, a grouped sum per node; the driver folds the grid with the two kernels by Fourier
transforms, and the potentials, whose size the grid bounds whatever the rows, go back to all tasks. Sums are of whole
numbers, so that a second training gives the same bits, however tasks are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import checked, doubles
from ..model import Model, joiner
from ..plans.graph import cut, shared_folder, stored
from .neighbors import knn_regression, nearest

#: Nodes of a box in each dimension, and most boxes.
NODES, MOST = 3, 160


def _widths(perplexity: float):
    """Probabilities of a row's neighbours by a Gaussian that gives the perplexity, by halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qid, near in zip(batch["qid"], batch["near"], strict=True):
                d2 = np.array([x["distance"] for x in near], "f8") ** 2
                low, high, goal = 0.0, np.inf, math.log(min(perplexity, len(d2)))
                beta, base = 1.0 / max(d2.mean(), 1e-300), d2.min()
                for _ in range(100):
                    p = np.exp(-beta * (d2 - base))
                    entropy = math.log(p.sum()) + beta * ((d2 - base) * p).sum() / p.sum()
                    if abs(entropy - goal) < 1e-7:
                        break
                    if entropy > goal:
                        low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
                    else:
                        high, beta = beta, (low + beta) / 2
                yield pd.DataFrame({"i": int(qid), "j": [int(x["tid"]) for x in near], "p": p / p.sum()})

    return run


def affinities(df: DataFrame, features: Sequence[str], row_id: str, perplexity: float) -> DataFrame:
    """i, j, p of both directions; p sums to 1 over all."""
    n = df.count()
    k = min(n - 1, max(2, int(3 * perplexity)))
    near = nearest(df, df, features, k, row_id, row_id, skip_self=True)
    lists = near.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("distance", "tid"))).alias("near"))  # k of each
    one = lists.mapInPandas(_widths(min(perplexity, max(2.0, n - 1.0))), "i long, j long, p double")
    both = one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return both.groupBy("i", "j").agg((F.sum("p") / (2 * n)).alias("p"))


def _weights(y: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """First node of each place's box, and the weights of the box's nodes."""
    box = np.floor(y / width)
    t = (y / width - box) * NODES - 0.5  # nodes at 0, 1, 2
    w = np.stack([(t - 1) * (t - 2) / 2, t * (2 - t), t * (t - 1) / 2], 1)
    return box.astype("i8") * NODES, w


def _charges(width: float, scale: float):
    """Charges of a task's rows on the nodes of the grid, as whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = batch[["y1", "y2"]].to_numpy("f8")
            (a, u), (b, v) = (_weights(y[:, k], width) for k in range(2))
            node = ((a[:, None] + np.arange(NODES))[:, :, None] << 32) + (b[:, None] + np.arange(NODES))[:, None, :]
            w = u[:, :, None] * v[:, None, :]
            node, of = np.unique(node.ravel(), return_inverse=True)
            cols = [np.rint(w * c[:, None, None] * scale).astype("i8").ravel() for c in (np.ones(len(y)), y[:, 0], y[:, 1])]
            sums = [np.zeros(len(node), "i8") for _ in cols]
            for s, c in zip(sums, cols, strict=True):
                np.add.at(s, of, c)
            yield pd.DataFrame({"node": node} | {f"c{k}": s for k, s in enumerate(sums)})

    return run


class Field:
    """Potentials of the charges on a grid that covers all of them."""

    def __init__(self, node: np.ndarray, charges: np.ndarray, width: float, n: int):
        x, y = node >> 32, node & 0xFFFFFFFF
        y = np.where(y >= 1 << 31, y - (1 << 32), y)
        x = (node - y) >> 32
        self.x0, self.y0, self.width = int(x.min()), int(y.min()), width
        size = int(max(x.max() - self.x0, y.max() - self.y0)) + 1
        q = np.zeros((3, size, size))
        q[:, x - self.x0, y - self.y0] = charges.T
        step = width / NODES
        d = np.minimum(np.arange(2 * size), 2 * size - np.arange(2 * size)) * step
        square = 1 / (1 + d[:, None] ** 2 + d[None] ** 2)
        f = np.fft.rfft2(q, (2 * size, 2 * size))
        fold = lambda kernel, some: np.fft.irfft2(np.fft.rfft2(kernel)[None] * some, (2 * size, 2 * size))[:, :size, :size]
        self.total = float((fold(square, f[:1])[0] * q[0]).sum()) - n
        self.grid = fold(square * square, f).astype("f8")

    def force(self, y: np.ndarray) -> np.ndarray:
        """Repulsion of each place, before division by the total."""
        (a, u), (b, v) = (_weights(y[:, k], self.width) for k in range(2))
        i, j = a[:, None] - self.x0 + np.arange(NODES), b[:, None] - self.y0 + np.arange(NODES)
        p = (self.grid[:, i[:, :, None], j[:, None, :]] * (u[:, :, None] * v[:, None, :])[None]).sum((2, 3))
        return y * p[0][:, None] - p[1:].T


def _moved(field: Field, n: int, exaggeration: float, rate: float, momentum: float, scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y, v = batch[["y1", "y2"]].to_numpy("f8"), batch[["v1", "v2"]].to_numpy("f8")
            pull = batch[["a1", "a2"]].to_numpy("f8") / scale
            grad = 4 * (exaggeration * pull - field.force(y) / max(field.total, 1e-300))
            v = momentum * v - rate * grad * (n - 1) / n
            y = y + v
            yield pd.DataFrame({"id": batch["id"], "y1": y[:, 0], "y2": y[:, 1], "v1": v[:, 0], "v2": v[:, 1]})

    return run


STATE = "id long, y1 double, y2 double, v1 double, v2 double"


def tsne(df: DataFrame, features: Sequence[str], row_id: str, perplexity: float = 30.0, rounds: int = 300, rate: float = 0.0, momentum: float = 0.8, exaggeration: float = 12.0, early: int = 250) -> DataFrame:
    """row_id, y1, y2. Attraction counts `exaggeration` times, with momentum 0.5, in the first `early` rounds.
    A rate of 0 means rows / (2 exaggeration): larger ones make small tables swing."""
    x = doubles(features)
    rows = cut(checked(df, features, row_id).select(F.col(row_id).cast("long").alias("id"), *[c.alias(f) for c, f in zip(x, features, strict=True)]))
    n = rows.count()
    if n < 2:
        raise ValueError("t-SNE needs two rows or more")
    rate = rate or n / (2 * exaggeration)
    pairs = stored(affinities(rows, features, "id", perplexity))
    unit = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    far = lambda s: 1e-4 * F.sqrt(-2 * F.log(unit(s))) * F.cos(2 * math.pi * unit(s + 1))
    now = stored(rows.select("id", far(1).alias("y1"), far(3).alias("y2"), F.lit(0.0).alias("v1"), F.lit(0.0).alias("v2")))
    for k in range(rounds):
        top = now.agg(F.max(F.greatest(F.abs("y1"), F.abs("y2")))).first()[0]
        width = 0.5 * 2.0 ** max(0, math.ceil(math.log2(2 * top / MOST / 0.5))) if top else 0.5  # the grid has at most MOST boxes a side, or one more
        scale = 2.0 ** min(36, 58 - math.ceil(math.log2(n * MOST * NODES * width)))
        got = now.mapInPandas(_charges(width, scale), "node long, c0 long, c1 long, c2 long").groupBy("node").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(3)]).toPandas()
        field = Field(got["node"].to_numpy("i8"), got[["c0", "c1", "c2"]].to_numpy("f8") / scale, width, n)
        fine = 2.0**40  # a row's pulls are below 1 together, times its distance
        at = pairs.join(now.select(F.col("id").alias("j"), F.col("y1").alias("z1"), F.col("y2").alias("z2")), "j").join(now.select(F.col("id").alias("i"), "y1", "y2"), "i")
        near = F.col("p") / (1 + (F.col("y1") - F.col("z1")) * (F.col("y1") - F.col("z1")) + (F.col("y2") - F.col("z2")) * (F.col("y2") - F.col("z2")))
        pull = at.groupBy(F.col("i").alias("id")).agg(*[F.sum(F.rint(near * (F.col(f"y{c}") - F.col(f"z{c}")) * fine).cast("long")).alias(f"a{c}") for c in (1, 2)])
        both = now.join(pull, "id", "left").fillna(0, ["a1", "a2"])
        first = k < min(early, rounds)
        now = stored(both.mapInPandas(_moved(field, n, exaggeration if first else 1.0, rate, 0.5 if first else momentum, fine), STATE))
    return now.select(F.col("id").alias(row_id), "y1", "y2")


def tsne_train(df: DataFrame, features: Sequence[str], **params) -> Model:
    """The layout as a model: another row is placed where its nearest training row stands; `prediction` is the first number."""
    rows = cut(checked(df, features).select(*[c.alias(f) for c, f in zip(doubles(features), features, strict=True)]).withColumn("_id", F.monotonically_increasing_id()))
    out = tsne(rows, features, "_id", **params)
    path = shared_folder(df.sparkSession, "layout")
    rows.join(out, "_id").write.parquet(path)
    return Model("tsne", list(features), {"table": path}, n_samples=rows.count())


@joiner("tsne")
def _placed(model: Model, df: DataFrame, out: str) -> DataFrame:
    known = df.sparkSession.read.parquet(model.state["table"])
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    found = knn_regression(known, rows, model.features, "y1", 1, "_id", "_row").select(F.col("qid").alias("_row"), F.col("prediction").alias(out))
    return rows.join(found, "_row", "left").drop("_row")
