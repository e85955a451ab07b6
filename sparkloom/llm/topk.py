"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers, floor(scale * x), and one coordinate sqrt(M - |v|^2) more, M being the largest |v|^2: then
|q - v|^2 = |q|^2 + M - 2 q.v for every query q (whose own extra coordinate is 0), and the largest inner product is the
nearest neighbour. Each vector is keyed by its nearest pivot and its distance to it; keys fall into annuli. By the
triangle inequality no vector of an annulus [r0, r1] around p is nearer to q than |q - p| - r1 or r0 - |q - p|, which
bounds its scores from above. Queries visit annuli in order of that bound, a few in the first round and more in each
following one, and stop where the bound falls below their k-th best score so far. Nothing is cut off otherwise, so the
result is exact whatever the pivots.

Pivots and annulus edges come from a bounded sample; every row is indexed. An annulus is dealt into blocks of about `block`
vectors. Each round counts the visits per block first: blocks without any stay at home, and one with more than
`query_block` visits goes out once per so many, so that neither a crowded annulus nor many queries meet in one task. What
the driver holds is a summary row per annulus: four to a pivot, more on larger tables, at most max_pivots * max_rings.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; shorter
vectors count as padded with zeros; rows that repeat an id count once, with their least vector; ties go to the smaller
id; an empty table gives no rows; columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, matched

SLACK = 1e-6


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id and v (array of long) of the rows that take part, one of each id."""
    x = F.col(embedding)
    big = float(1 << 52)
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(big)), F.lit(-big))))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    at = column.offsets.to_numpy().astype("i8")
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    if len(size) and (size == dim).all():
        return values[at[0] : at[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim), "i8")
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where they hold every sum exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype("f8") @ b.astype("f8").T).astype("i8") if most < 2**53 else a @ b.T


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype("f8")
    return np.hstack([v, np.sqrt(np.maximum(top - (v**2).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample's vector farthest from those chosen before."""
    at = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(at) < min(n, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[at[-1:]])[:, 0])
    return sample[at]


def _keys(dim: int, top: float, pivots: np.ndarray, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            d = _distances(_lift(v, top), pivots)
            p = d.argmin(1) if len(v) else np.zeros(0, "i8")
            r = d[np.arange(len(v)), p]
            ring = (r[:, None] > edges[p]).sum(1)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"),
                "v": pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary()),
                "cell": pa.array(p * (edges.shape[1] + 1) + ring, pa.int32()),
                "r": pa.array(r),
            })

    return run


def _visits(dim: int, top: float, pivots: np.ndarray, cells: pd.DataFrame, first: int, last: int | None):
    """The annuli that a query visits in a round: number `first` to `last` in its own order of bounds."""
    pivot_of = (cells["cell"].to_numpy() // cells.attrs["rings"]).astype(int)
    low, high, blocks = (cells[c].to_numpy() for c in ("low", "high", "blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q = np.frombuffer(b"".join(batch["v"]), "<i8").reshape(-1, dim).astype("f8")
            q = np.hstack([q, np.zeros((len(q), 1))])
            d = _distances(q, pivots)[:, pivot_of]
            least = np.maximum(np.maximum(d - high, low - d), 0)
            bound = ((q**2).sum(1)[:, None] + top - np.maximum(least * (1 - SLACK) - SLACK, 0) ** 2) / 2 + 1e-9 * top
            order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
            floor = batch["floor"].fillna(-np.inf).to_numpy("f8")
            go = np.take_along_axis(bound, order, 1) >= floor[:, None]
            row, k = np.nonzero(go)
            cell = order[row, k]
            n = blocks[cell]
            row, cell = np.repeat(row, n), np.repeat(cell, n)
            block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            out = batch.iloc[row][["vec_id", "v", "floor"]].rename(columns={"vec_id": "query_id"})
            yield out.assign(place=(cells["cell"].to_numpy()[cell].astype("i8") << 32) | block)

    return run


def _compare(dim: int, k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series([], dtype="i8"), "vec_id": pd.Series([], dtype="i8"), "score": pd.Series([], dtype="i8")})
        if not len(candidates) or not len(queries):
            return none
        ids = candidates["vec_id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        c = np.frombuffer(b"".join(candidates["v"]), "<i8").reshape(-1, dim)[order]
        out = []
        for at in range(0, len(queries), 512):
            some = queries.iloc[at : at + 512]
            q_ids = some["query_id"].to_numpy()
            score = products(np.frombuffer(b"".join(some["v"]), "<i8").reshape(-1, dim), c)
            ok = (ids[None] != q_ids[:, None]) & (score >= some["floor"].fillna(-np.inf).to_numpy("f8")[:, None])
            if len(ids) > k:  # the k best of this block; ids ascend, so a stable order breaks ties
                kth = np.partition(np.where(ok, score, np.iinfo("i8").min), len(ids) - k, axis=1)[:, len(ids) - k]
                ok &= score >= kth[:, None]
            row, col = np.nonzero(ok)
            out.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": ids[col], "score": score[row, col]}))
        return pd.concat(out)

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0,
    max_rings: int = 64, max_pivots: int = 128, block: int = 4096, query_block: int = 8192, sample: int = 8192, first_visits: int = 4,
) -> DataFrame:
    """Each query's k best: query_id, rank, vec_id, score. `is_query` is a condition on vec_id."""
    kinds = "query_id long, rank int, vec_id long, score long"
    rows = cut(integers(vectors, vec_id, embedding, scale))
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, top, n_queries = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm), F.count(F.when(is_query, 1))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], kinds)
    dim = max(dim, 1)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    some = _lift(np.array([[*r["v"], *[0] * (dim - len(r["v"]))] for r in some], "i8"), top)
    pivots = choose_pivots(some, int(np.clip(-(-n // block), 4, max_pivots)))
    rings = int(np.clip(n // (block * len(pivots)), 4, max_rings))
    d = _distances(some, pivots)
    own, at = d.min(1), d.argmin(1)
    split = np.linspace(0, 1, rings + 1)[1:-1]
    edges = np.stack([np.quantile(own[at == p] if (at == p).any() else own, split) for p in range(len(pivots))])
    index = cut(rows.mapInArrow(_keys(dim, top, pivots, edges), "vec_id long, v binary, cell int, r double"))
    cells = index.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).toPandas().sort_values("cell")
    cells["blocks"] = -(-cells["n"] // block)
    cells.attrs["rings"] = rings
    blocks_of = F.create_map(*[F.lit(int(x)) for pair in zip(cells["cell"], cells["blocks"], strict=True) for x in pair])
    place = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("vec_id"), blocks_of[F.col("cell")])
    candidates = index.select("vec_id", "v", place.alias("place"))
    queries = index.where(is_query).select("vec_id", "v")
    best, done, step = None, 0, first_visits
    while done < len(cells):
        last = done + step if done + step < len(cells) and step < len(cells) // 2 else None
        floor = F.lit(None).cast("double").alias("floor")
        asked = queries.select("vec_id", "v", floor)
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
            asked = queries.join(kth, "vec_id", "left")
        visits = asked.mapInPandas(_visits(dim, top, pivots, cells, done, last), "query_id long, v binary, floor double, place long")
        counts = cut(visits.groupBy("place").agg(F.count("*").alias("c")))
        chunks = F.ceil(F.col("c") / query_block).cast("int")
        keys = ("place", "chunk")
        visits = matched(visits, counts, "place").withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks).cast("int")).drop("c")
        sent = candidates.join(counts, "place").select("vec_id", "v", "place", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        found = sent.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(_compare(dim, k), "query_id long, vec_id long, score long")
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if last is None:
            break
        best = cut(best)
        done, step = last, step * 4
    return best
