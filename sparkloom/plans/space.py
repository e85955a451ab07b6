"""A k-d split of points into boxes, for joins by distance.

The tree is fitted on a bounded sample and has at most `MOST` leaves, so that it and the boxes of its leaves may go to every
task; a leaf with more rows than a task should hold is dealt into blocks by hash, all of which are asked where one is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 14
#: Points, and numbers in them, that a tree is fitted on.
SAMPLE, NUMBERS = 50_000, 2_000_000


class Tree:
    """Splits at the median of the widest feature, level by level; `lo` and `hi` are the boxes of all nodes once known."""

    def __init__(self, sample: np.ndarray, depth: int):
        inner = (1 << depth) - 1
        self.depth, self.axis, self.at = depth, np.zeros(inner, "i4"), np.full(inner, np.inf)
        todo = [(0, np.arange(len(sample)))] if inner and len(sample) else []
        while todo:
            node, rows = todo.pop()
            x = sample[rows]
            spread = x.max(0) - x.min(0)
            k = int(spread.argmax())
            if spread[k] <= 0:
                continue  # all go left
            cut = np.partition(x[:, k], (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
            if cut == x[:, k].max():  # the upper half is one value
                cut = x[x[:, k] < cut, k].max()
            self.axis[node], self.at[node] = k, cut
            left = x[:, k] <= cut
            for child, some in ((2 * node + 1, rows[left]), (2 * node + 2, rows[~left])):
                if child < inner and len(some) > 1:
                    todo.append((child, some))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(x), "i8"), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.axis[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)

    def bound(self, leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Boxes of the leaves that hold rows, and of the nodes above them."""
        first = (1 << self.depth) - 1
        self.lo, self.hi = np.full((2 * first + 1, lo.shape[1]), np.inf), np.full((2 * first + 1, lo.shape[1]), -np.inf)
        self.lo[first + leaves], self.hi[first + leaves] = lo, hi
        for node in range(first - 1, -1, -1):
            self.lo[node] = np.minimum(self.lo[2 * node + 1], self.lo[2 * node + 2])
            self.hi[node] = np.maximum(self.hi[2 * node + 1], self.hi[2 * node + 2])

    def within(self, lo: np.ndarray, hi: np.ndarray, reach: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """For each box [lo, hi] the leaves whose box is no further than `reach`: the box's number and the leaf."""
        out = []
        for a in range(0, len(lo), step):
            of, node = np.arange(a, min(a + step, len(lo))), np.zeros(min(step, len(lo) - a), "i8")
            for level in range(self.depth + 1):
                if level:
                    of, node = np.concatenate([of, of]), np.concatenate([2 * node + 1, 2 * node + 2])
                gap = np.maximum(np.maximum(self.lo[node] - hi[of], lo[of] - self.hi[node]), 0)
                near = np.sqrt((gap * gap).sum(1)) <= reach[of] * (1 + 1e-9)  # no near one is lost to rounding
                of, node = of[near], node[near]
            out.append((of, node - ((1 << self.depth) - 1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, "i8"),) * 2


def matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.array(column.tolist(), "f8").reshape(-1, d)


def stacked(column: pd.Series, d: int) -> np.ndarray:
    """The same, of arrays as Arrow gives them."""
    return np.concatenate(column.to_numpy()).astype("f8", copy=False).reshape(-1, d) if len(column) else np.zeros((0, d))


def fit(points: DataFrame, d: int, n: int, rows: int) -> Tree:
    """A tree over the column x of `points`, with about `rows` of its `n` rows a leaf."""
    leaves = min(MOST, max(1, n // max(rows, 1)))
    depth = math.ceil(math.log2(leaves)) if leaves > 1 else 0
    if not depth:
        return Tree(np.zeros((0, d)), 0)
    size = min(SAMPLE, max(1000, NUMBERS // d))
    every = max(1, n // size)
    some = points.select("x").where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).distinct().limit(4 * size).collect()
    sample = np.array(sorted(r[0] for r in some), "f8").reshape(-1, d)
    return Tree(sample, min(depth, max(0, int(math.log2(max(1, len(sample)))))))


def leaf_of(tree: Tree, d: int) -> Column:
    @F.pandas_udf("int")
    def go(x: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(matrix(x, d)).astype("i4"))

    return go("x")


def corners(d: int) -> list[Column]:
    """Aggregates of the box around x."""
    return [F.array(*[f(F.col("x")[k]) for k in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]


def blocked(points: DataFrame, tree: Tree, d: int, rows: int, key: str) -> tuple[DataFrame, dict[int, int]]:
    """`points` with leaf and block (a leaf's rows dealt by `key` into blocks of about `rows`), and each leaf's blocks.

    The boxes of the leaves are put into the tree; what the driver gets is a row per leaf.
    """
    placed = points.withColumn("leaf", leaf_of(tree, d) if tree.depth else F.lit(0))
    found = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *corners(d)).collect()
    tree.bound(np.array([r.leaf for r in found], "i8"), np.array([r.lo for r in found], "f8").reshape(-1, d), np.array([r.hi for r in found], "f8").reshape(-1, d))
    many = {r.leaf: -(-r.n // (2 * rows)) for r in found}
    split = {k: v for k, v in many.items() if v > 1}
    parts = F.lit(1)
    if split:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in sorted(split.items()) for v in kv]), F.col("leaf")), F.lit(1))
    return placed.withColumn("block", F.col("leaf").cast("long") * (1 << 24) + F.pmod(F.xxhash64(key), parts)), many
