"""The embedding operators against brute force, with nulls, bad components, copies and repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import forest, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, e int, rep string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 16)).astype("f4")
    near = x[:60] + 0.08 * rng.normal(size=(60, 16)).astype("f4")
    out = [*x, *near, *(x[0] * 2 for _ in range(5)), *(x[1] for _ in range(30))]
    out = [(k, v.tolist()) for k, v in enumerate(out)]
    n = len(out)
    out += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [float("inf")] * 16), (None, x[2].tolist()), (5, out[5][1]), (20, x[3].tolist()), (n + 5, [1.0, 2.0]), (n + 6, [])]
    return [(i, v, 1, "clash", 2, None) for i, v in out]


def clean(rows, zero_ok):
    best = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(c is None or not np.isfinite(c) for c in v) or (not zero_ok and not any(v)):
            continue
        best.setdefault(i, []).append(v)
    return best


@pytest.mark.parametrize("leaf,block", [(384, 2048), (40, 2048), (60, 25)])
def test_forest(spark, rows, leaf, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.vec_id: r for r in forest.near_duplicates(df, leaf=leaf, block=block).collect()}
    best = {i: min(vs) for i, vs in clean(rows, True).items()}
    ids = sorted(i for i, v in best.items() if any(v))
    x = np.array([[*best[i], *[0.0] * (16 - len(best[i]))] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        low = np.minimum(label, np.where(near, label[None], len(ids)).min(1))
        if (low == label).all():
            break
        label = low
    assert set(got) == {i for i, *_ in rows}
    missed = 0
    for k, i in enumerate(ids):
        assert got[i].n_links <= near[k].sum()
        missed += near[k].sum() - got[i].n_links
        if not missed:
            assert got[i].component_id == ids[label[k]]
        assert got[i].kept == (got[i].component_id == i)
    assert missed <= 0.02 * near.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in got if i not in ids)
    assert forest.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,pivots", [(4096, 128), (50, 16)])
def test_topk(spark, rows, block, pivots):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.search(df, F.col("vec_id") % 20 == 0, block=block, max_pivots=pivots, query_block=7, first_visits=2).collect()
    best = {i: min([int(np.floor(64 * float(c))) for c in v] for v in vs) for i, vs in clean(rows, True).items()}
    ids = np.array(sorted(best))
    x = np.array([[*best[i], *[0] * (16 - len(best[i]))] for i in ids], "i8")
    want = []
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[k]
            order = [j for j in np.lexsort((ids, -s)) if j != k][:20]
            want += [(int(i), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
