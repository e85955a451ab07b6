"""The k-d split and what stands on it: neighbours, density clusters, the two-dimensional layout."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cluster, mining, neighbors, tsne
from sparkloom.plans import space


def frame(spark, x, y=None):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(i, *map(float, r), float(0 if y is None else y[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(3), names


def test_tree_deals_every_point_and_finds_every_near_box():
    rng = np.random.default_rng(0)
    for d in (1, 3, 20):
        x = np.round(rng.normal(size=(500, d)), 1)
        x[:200] = x[0]
        tree = space.Tree(x, 5)
        leaf = tree.leaf(x)
        there = np.unique(leaf)
        tree.bound(there, np.array([x[leaf == k].min(0) for k in there]), np.array([x[leaf == k].max(0) for k in there]))
        q, reach = x[::7], rng.uniform(0, 2, len(x[::7]))
        of, found = tree.within(q, q, reach)
        met = set(zip(of.tolist(), found.tolist(), strict=True))
        near = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1)) <= reach[:, None]
        assert {(i, int(leaf[j])) for i, j in zip(*np.nonzero(near), strict=True)} <= met


@pytest.mark.parametrize("d", [2, 6])
def test_pruned_neighbours_are_exact(spark, d):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(600, d)), 1)
    x[:80] = x[0]  # one point holds many rows
    df, names = frame(spark, x)
    counted = {}
    got = {}
    for r in neighbors.nearest(df, df, names, 4, "id", "id", skip_self=True, block=20, counted=counted).collect():
        got.setdefault(r.qid, {})[r.rank] = r.tid
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    want = np.argsort(dist, axis=1, kind="stable")[:, :4]
    assert all([got[i][k] for k in range(1, 5)] == want[i].tolist() for i in range(len(x)))
    assert counted["met"] < counted["all"] * (0.5 if d == 2 else 0.7)


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core, name = near.sum(1) >= least, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        todo = [i] if name[i] < 0 else []
        name[i] = i if name[i] < 0 else name[i]
        while todo:
            for b in np.flatnonzero(near[todo.pop()] & core & (name < 0)):
                name[b] = i
                todo.append(b)
    for i in np.flatnonzero(~core):
        beside = name[near[i] & core]
        name[i] = beside.min() if len(beside) else -1
    return {i: (None if name[i] < 0 else int(name[i]), bool(core[i])) for i in range(len(x))}


@pytest.mark.parametrize("d,eps,least,rows", [(1, 0.05, 3, 20), (2, 0.3, 5, 20), (64, 9.5, 4, 25), (2, 5.0, 5, 20)])
def test_dbscan_of_any_dimension(spark, d, eps, least, rows):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(300, d)), 2)
    x[:40] = x[0]
    df, names = frame(spark, x)
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(df, names, "id", eps, least, rows).collect()}
    assert got == brute_dbscan(x, eps, least)


def test_dense_regions_make_no_pairs_of_points(spark, monkeypatch):
    """Points that all lie within eps: whole blocks are told by their boxes, and no task compares points."""

    def refuse(*_):
        raise AssertionError("points were compared")

    monkeypatch.setattr(cluster, "_squares", refuse)
    x = np.random.default_rng(5).uniform(0, 0.1, (400, 3))
    df, names = frame(spark, x)
    out = cluster.dbscan(df, names, "id", 1.0, 5, 20).collect()
    assert {(r.cluster, r.core) for r in out} == {(0, True)}


def test_field_of_charges_by_brute_force():
    y = np.random.default_rng(1).normal(size=(300, 2)) * 8
    got = pd.concat(list(tsne._charges(0.5, 2.0**36)(iter([pd.DataFrame(y, columns=["y1", "y2"])])))).groupby("node").sum()
    field = tsne.Field(got.index.to_numpy("i8"), got.to_numpy("f8") / 2.0**36, 0.5, 300)
    square = 1 + ((y[:, None] - y[None]) ** 2).sum(-1)
    want = ((y[:, None] - y[None]) / (square**2)[:, :, None]).sum(1)
    assert field.total == pytest.approx((1 / square).sum() - 300, rel=0.01)
    assert np.abs(field.force(y) - want).max() < 0.02 * np.abs(want).max()


def test_perplexity_is_met():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"qid": range(5), "near": [[{"distance": float(v), "tid": k} for k, v in enumerate(np.sort(rng.uniform(0.1, 9, 40)))] for _ in range(5)]})
    for out in tsne._widths(12.0)(iter([rows])):
        assert out["p"].sum() == pytest.approx(1) and np.exp(-(out["p"] * np.log(out["p"].clip(lower=1e-300))).sum()) == pytest.approx(12, rel=1e-4)


def test_layout_keeps_groups_apart_and_repeats(spark):
    rng = np.random.default_rng(42)
    centers = np.array([(2, 2), (2, -2), (-2, 2), (-2, -2)])
    x = np.array([centers[i % 4] + rng.normal(0, 0.35, 2) for i in range(100)])
    df, names = frame(spark, x)
    out = tsne.tsne(df, names, "id", perplexity=12, rounds=14, early=14).toPandas().sort_values("id")
    y, label = out[["y1", "y2"]].to_numpy(), np.arange(100) % 4
    dist, same = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), label[:, None] == label[None]
    assert dist[same].mean() < 0.5 * dist[~same].mean()
    first, again = (sorted(map(tuple, tsne.tsne(d, names, "id", perplexity=12, rounds=1, early=1).collect())) for d in (df, df.repartition(2)))
    assert first == again


def test_seeds_and_empty_centers(spark):
    """k in the thousands, seeds from all rows, and centers that would stay without rows."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(3000, 2)), [[500.0, 500.0]], np.repeat([[9.0, 9.0]], 800, 0)])
    df, names = frame(spark, x)
    seeds = np.array(cluster.seeds(df, [F.col(n) for n in names], 2500))
    assert len(np.unique(seeds, axis=0)) == 2500 and (seeds == 500).all(1).any() and {tuple(s) for s in seeds} <= {tuple(r) for r in x}
    assert cluster.seeds(df.repartition(2), [F.col(n) for n in names], 40) == cluster.seeds(df, [F.col(n) for n in names], 40)
    m = cluster.kmeans(df, names, 2500, rounds=1)
    assert len(m.state["centers"]) == 2500 and m.transform(df.limit(5)).where("prediction is null").isEmpty()
    far = cluster.kmeans(df, names, centers=[[0.0, 0.0], [9.0, 9.0], [-800.0, 0.0]], rounds=3)
    assert np.allclose(sorted(far.state["centers"])[-1], [500, 500])
    with pytest.raises(ValueError, match="from 1 to 2"):
        cluster.seeds(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double"), [F.col("x")], 3)


def test_itemsets_of_large_baskets(spark):
    """Baskets of 200 items: sets are counted without listing their occurrences; and against enumeration."""
    rng = np.random.default_rng(2)
    common = [f"c{k:03}" for k in range(12)]
    baskets = [(b, [*common, *(f"r{v}" for v in rng.choice(5000, 188, replace=False))]) for b in range(60)]
    df = spark.createDataFrame(baskets, "tid long, items array<string>").repartition(3)
    found, n = mining.frequent_itemsets(mining.basket_items(df, "tid", "items"), 0.9)
    sizes = {r["size"]: (r["count"], r["least"]) for r in found.groupBy("size").agg(F.count("*").alias("count"), F.min("n").alias("least")).collect()}
    assert n == 60 and sizes == {k: (math.comb(12, k), 60) for k in range(1, 13)}
    rows = [(b, [x for x in "abcdefg" if rng.random() < 0.6]) for b in range(80)]
    df = spark.createDataFrame(rows, "tid long, items array<string>").repartition(3)
    found, n = mining.frequent_itemsets(mining.basket_items(df, "tid", "items"), 0.2, 4)
    want = {}
    for size in range(1, 5):
        for s in itertools.combinations("abcdefg", size):
            c = sum(set(s) <= set(items) for _, items in rows)
            if c >= math.ceil(0.2 * n - 1e-9):
                want[s] = c
    assert {tuple(r["items"]): r["n"] for r in found.collect()} == want
    with pytest.raises(ValueError, match="over 3 itemsets"):
        mining.frequent_itemsets(mining.basket_items(df, "tid", "items"), 0.2, 4, most=3)


def test_average_linkage_of_whole_tables(spark):
    """Rounds of reciprocal neighbours give the groups of the greedy merging of all pairs."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(5, 2)) + c for c in ((0, 0), (5, 1), (2, 7))])
    df, names = frame(spark, np.concatenate([x, x[:3]]))
    rounds = cluster.agglomerative(df, names, 4, "average", most=5)
    greedy = cluster.agglomerative(df, names, 4, "average", most=10_000)
    assert np.allclose(sorted(rounds.state["centers"]), sorted(greedy.state["centers"])) and rounds.n_samples == greedy.n_samples == 18


def test_single_linkage_of_whole_tables(spark):
    """A spanning tree over several blocks, its edges cut, gives the groups of the greedy merging of all pairs."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in ((0, 0, 0), (9, 1, 0), (2, 9, 4))])
    df, names = frame(spark, np.concatenate([x, x[:3]]))
    points = df.groupBy(*names).agg(F.count("*").alias("n"))
    tree = cluster._by_tree(points, names, 5, rows=30)
    greedy = cluster.agglomerative(df, names, 5, "single", most=10_000)
    assert np.allclose(sorted(tree.state["centers"]), sorted(greedy.state["centers"])) and tree.n_samples == greedy.n_samples == 123


def test_layout_rounds_do_not_multiply_estimates(spark):
    """A round hands on a table: its plan's estimate of size doesn't grow, by which the twentieth round was never planned."""
    df, names = frame(spark, np.random.default_rng(5).normal(size=(40, 2)))
    size = [str(tsne.tsne(df, names, "id", perplexity=5, rounds=k, early=1)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for k in (1, 3)]
    assert len(size[1]) <= len(size[0]) + 1


def test_neighbours_where_boxes_skip_nothing(spark):
    """Groups of both sides meet in bounded numbers, by products: the same rows, ties and copies as by differences."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(700, 12)) + 1e3, 1)
    x[:90], x[90:150] = x[0], x[90:150].round()
    df, names = frame(spark, x)
    counted, got = {}, {}
    for r in neighbors.nearest(df, df, names, 4, "id", "id", skip_self=True, block=20, counted=counted, sent=0).collect():
        got.setdefault(r.qid, {})[r.rank] = r.tid
    dist = np.zeros((700, 700))
    for c in range(12):
        dist += (x[:, c, None] - x[None, :, c]) ** 2
    dist = np.sqrt(dist)
    np.fill_diagonal(dist, np.inf)
    want = np.argsort(dist, axis=1, kind="stable")[:, :4]
    assert [[got[i][k] for k in range(1, 5)] for i in range(700)] == want.tolist()


def test_dbscan_where_boxes_skip_nothing(spark, monkeypatch):
    """Hubs connect most core points; what they leave, counts in doubt and border points are compared with all."""
    for name, value in (("GROUP", 90), ("GROUPS", 2), ("OWN", 60), ("HUBS", 4)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[:40], x[200:] = x[0], x[200:] + 5
    df, names = frame(spark, x)
    want = brute_dbscan(x, 1.3, 4)
    assert len({c for c, _ in want.values()}) > 3 and any(c is not None and not core for c, core in want.values())
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(df, names, "id", 1.3, 4, 20, sent=0).collect()}
    assert got == want


def test_nearness_by_products_is_that_by_differences():
    rng = np.random.default_rng(13)
    for d, shift in itertools.product((1, 3, 64), (0, 1e3, 1e9)):
        x = np.round(rng.normal(size=(300, d)), 1) + shift
        for eps in (0.1, 0.5, d**0.5, 1e9):
            got = np.concatenate([near for _, near in cluster._within(x, x[::2], eps)])
            assert (got == (cluster._squares(x, x[::2]) <= eps * eps)).all()


def test_dense_regions_compare_no_points(spark, monkeypatch):
    """As above: nearness by products isn't asked for either."""

    def refuse(*_):
        raise AssertionError("points were compared")

    monkeypatch.setattr(cluster, "_within", refuse)
    df, names = frame(spark, np.random.default_rng(5).uniform(0, 0.1, (400, 3)))
    assert {(r.cluster, r.core) for r in cluster.dbscan(df, names, "id", 1.0, 5, 20).collect()} == {(0, True)}
