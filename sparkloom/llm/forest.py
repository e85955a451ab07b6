"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

1. Identical vectors fold into a class with a count, so that copies never meet each other pair by pair.
2. Every tree splits by random directions at medians of a bounded sample; below the depth that the sample supports,
   splits go on by directions shared over a level, at medians of the last sampled node. A vector within `spill` of a
   split goes to both sides.
3. Within a leaf, cosines of all its classes are taken in double precision. A leaf with more than `block` rows is
   compared in pairs of blocks, each in a task of its own, so leaves may hold any share of the rows.
4. Each row carries the codes of its leaves before this one. A pair counts only in the smallest leaf code that both have,
   so every link is counted once though nothing but per-row sums and a spanning star per group leaves a task.
5. The stars' connected components give component_id.

With dim 64, threshold 0.95 and the default spill, a pair just at the threshold is parted by a level with a chance of
about 2 %, so that all four trees miss it with about 1 in 1,000 at ten levels, and 1 in 20 at thirty.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; shorter vectors
count as padded with zeros; rows that repeat an id count once, with their least vector; rows with a null id give one
row with null component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, cut


class Tree:
    """Splits of one tree: `sampled` levels at a sample's medians, then `extra` levels at medians of the sampled leaf."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, spill: float, least: int = 16):
        rng = np.random.default_rng([2718, seed])
        dim = sample.shape[1]
        self.spill, self.depth = spill, depth
        self.sampled = min(depth, max(0, int(np.log2(max(len(sample), 1) / least))))
        self.extra = rng.normal(size=(depth - self.sampled, dim))
        self.extra /= np.linalg.norm(self.extra, axis=1, keepdims=True) + 1e-300
        self.directions, self.cuts = np.zeros((1 << self.sampled, dim)), np.zeros(1 << self.sampled)
        nodes = {1: np.arange(len(sample))}
        for _ in range(self.sampled):
            below = {}
            for k, rows in nodes.items():
                w = rng.normal(size=dim)
                w /= np.linalg.norm(w)
                p = sample[rows] @ w
                self.directions[k], self.cuts[k] = w, np.median(p) if len(p) else 0
                below[2 * k], below[2 * k + 1] = rows[p <= self.cuts[k]], rows[p > self.cuts[k]]
            nodes = below
        self.deep = np.zeros((1 << self.sampled, depth - self.sampled))
        for k, rows in nodes.items():
            if len(rows):
                self.deep[k - (1 << self.sampled)] = np.median(sample[rows] @ self.extra.T, axis=0)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf number of every place where a row lands."""
        row, node = np.arange(len(x)), np.ones(len(x), "i8")
        for level in range(self.depth):
            if level < self.sampled:
                p = np.einsum("ij,ij->i", x[row], self.directions[node]) - self.cuts[node]
            else:
                k = level - self.sampled
                p = x[row] @ self.extra[k] - self.deep[(node >> k) - (1 << self.sampled), k]
            left, right = p <= self.spill, p > -self.spill
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def _matrix(vectors: list, dim: int) -> np.ndarray:
    if all(len(v) == dim for v in vectors):
        return np.array(vectors, "f8").reshape(-1, dim)
    return np.array([[*v, *[0.0] * (dim - len(v))] for v in vectors], "f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(trees: list[Tree], dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                raw = _matrix([np.asarray(v.values) for v in some.column("e")], dim)
                unit = _unit(raw)
                found = [tree.leaves(unit) for tree in trees]
                row = np.concatenate([r for r, _ in found])
                code = np.concatenate([(k << 48) | leaf for k, (_, leaf) in enumerate(found)])
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                ends = np.searchsorted(row, np.arange(len(raw) + 1))
                codes = [code[a:k].astype("<i8").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) for k in range(a, b)]
                raw_bytes = [x.tobytes() for x in raw.astype(kind)]
                yield pa.RecordBatch.from_pydict({
                    "code": pa.array(code),
                    "rep": some.column("rep").take(pa.array(row)),
                    "n": some.column("n").take(pa.array(row)),
                    "x": pa.array(raw_bytes, pa.binary()).take(pa.array(row)),
                    "codes": pa.array(codes, pa.binary()),
                })

    return run


def _owned(codes: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair share none of the leaf codes before this one."""
    wide = max((len(x) for x in codes), default=0)
    pad = lambda fill: np.array([np.concatenate([x, np.full(wide - len(x), fill)]) for x in codes], "i8").reshape(len(codes), wide)
    left, right = pad(-1), pad(-2)
    out = np.ones(len(p), bool)
    for at in range(0, len(p), 20_000):
        s = slice(at, at + 20_000)
        out[s] = ~(left[p[s]][:, :, None] == right[q[s]][:, None, :]).any((1, 2))
    return out


def _compare(dim: int, threshold: float, kind: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values("rep")
        x = _unit(np.frombuffer(b"".join(group["x"]), kind).astype("f8").reshape(-1, dim))
        rep, n, side = group["rep"].to_numpy(), group["n"].to_numpy(), group["side"].to_numpy()
        codes = [np.frombuffer(c, "<i8") for c in group["codes"]]
        if i == j:
            near = np.triu(x @ x.T >= threshold, 1)
        else:  # rows of the two blocks against each other
            near = ((x @ x.T >= threshold) & (side[:, None] == i) & (side[None] == j))
        p, q = np.nonzero(near)
        links = np.zeros(len(rep), "i8")
        mine = _owned(codes, p, q)
        np.add.at(links, p[mine], n[q[mine]])
        np.add.at(links, q[mine], n[p[mine]])
        root = np.arange(len(rep))
        while len(p):  # smallest row reached, by links and then by jumps
            low = root.copy()
            np.minimum.at(low, p, root[q])
            np.minimum.at(low, q, root[p])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.zeros(len(rep), bool)
        some[p] = some[q] = True
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[root[some]]})

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
    trees: int = 4, leaf: int = 384, block: int = 2048, sample: int = 16_384, spill: float | None = None,
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    # components of float columns travel as floats; cosines are taken in double precision
    kind = "<f4" if vectors.schema[embedding].dataType.elementType == FloatType() else "<f8"
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).groupBy("vec_id").agg(F.min("e").alias("e"))
    finite = F.forall("e", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    fine = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("e", lambda v: v != 0), F.lit(False))
    every = cut(every.withColumn("fine", fine))
    classes = cut(every.where("fine").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    count, dim = classes.agg(F.count("*"), F.max(F.size("e"))).first()
    if not count:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    some = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("e").collect()
    some = _unit(_matrix([r[0] for r in some], dim))
    depth = max(0, int(np.ceil(np.log2(count / leaf)))) if count > leaf else 0
    spill = 0.5 * float(np.sqrt(max(2 - 2 * threshold, 0) / dim)) if spill is None else spill
    forest = [Tree(some, depth, k, spill) for k in range(trees if depth else 1)]
    routed = classes.mapInArrow(_route(forest, dim, kind), "code long, rep long, n long, x binary, codes binary")
    routed = cut(routed)
    sizes = routed.groupBy("code").agg(F.ceil(F.count("*") / block).cast("int").alias("b"))
    side = F.pmod(F.xxhash64("rep"), F.col("b")).cast("int")
    dealt = routed.join(sizes, "code").withColumn("side", side).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    dealt = dealt.select("code", F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "rep", "n", "x", "codes")
    found = cut(dealt.groupBy("code", "i", "j").applyInPandas(_compare(dim, threshold, kind), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    classes = classes.join(links, "rep", "left").join(joined, "rep", "left")
    classes = classes.select("e", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.where("fine").select("vec_id", "e").join(classes, "e").select("vec_id", "n_links", "component_id")
    out = out.union(every.where("not fine").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
