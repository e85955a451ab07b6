"""Clustering: an iteration is one grouped aggregation; DBSCAN joins the blocks of a k-d split and takes components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import checked, doubles, first_least, squared_distance
from ..model import Model, scorer
from ..plans.graph import components, cut, stored
from ..plans.space import blocked, corners, fit, matrix, stacked
from ..stats import with_next
from .neighbors import nearest


@scorer("kmeans", "fuzzy_cmeans", "agglomerative", "dbscan")
def _nearest_center(state: dict, x: list[Column]) -> Column:
    if not state["centers"]:
        return F.lit(0.0)
    if len(state["centers"]) * len(x) > 1500:  # past what generated code can hold
        centers = np.array(state["centers"], "f8")

        @F.pandas_udf("double")
        def near(rows: pd.Series) -> pd.Series:
            return pd.Series([float(_distances(centers, np.array([r], "f8"))[0][0]) if r is not None and not any(v is None for v in r) else None for r in rows], dtype="float64")

        return near(F.array(*x))
    return first_least([squared_distance(c, x) for c in state["centers"]])


def _distances(centers: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the first nearest center and the squared distance, by differences and some rows at a time."""
    near, least = np.zeros(len(x), "i8"), np.zeros(len(x))
    step = max(1, 4_000_000 // max(1, centers.size))
    for low in range(0, len(x), step):
        d = ((x[low : low + step, None] - centers[None]) ** 2).sum(-1)
        near[low : low + step] = d.argmin(1)
        least[low : low + step] = d.min(1)
    return near, least


def seeds(df: DataFrame, x: list[Column], k: int, rounds: int = 5) -> list[list[float]]:
    """k-means|| over all rows: each round draws about 2k of them, a row's chance being its squared distance to those
    drawn before; what is drawn is weighted by the rows nearest to it, and k-means++ picks k of these. At most some
    10k rows are drawn, whatever the table's size; draws go by hashes of the rows and repeat."""
    d = len(x)
    points = df.select(F.array(*x).alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    first = [r[0] for r in points.orderBy(F.xxhash64("_x"), "_x").select("_x").limit(1).collect()]
    if not first or k < 1:
        raise ValueError("k must be from 1 to the number of different rows" if first else "no rows to train on")
    drawn = np.array(first, "f8").reshape(-1, d)

    def far(drawn: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(d=_distances(drawn, matrix(batch["_x"], d))[1])

        return points.mapInPandas(run, "_x array<double>, _n long, d double")

    for turn in range(rounds):
        rows = far(drawn)
        cost = rows.agg(F.sum(F.col("d") * F.col("_n"))).first()[0]
        if not cost:
            break
        chance = (F.pmod(F.xxhash64("_x", F.lit(turn)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        new = rows.where(chance < 2.0 * k * F.col("d") * F.col("_n") / F.lit(cost)).select("_x").collect()
        drawn = np.concatenate([drawn, np.array(sorted(r[0] for r in new), "f8").reshape(-1, d)])
    if len(drawn) < k:  # rare: few different rows, or short draws; the farthest ones make up
        more = far(drawn).where("d > 0").orderBy(F.desc("d"), "_x").limit(k - len(drawn)).collect()
        drawn = np.concatenate([drawn, np.array([r["_x"] for r in more], "f8").reshape(-1, d)])
    if len(drawn) < k:
        raise ValueError(f"k must be from 1 to {len(drawn)}")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = np.bincount(_distances(drawn, matrix(batch["_x"], d))[0], batch["_n"].to_numpy("f8"), len(drawn))
            yield pd.DataFrame({"k": np.flatnonzero(n), "n": n[n > 0]})

    weight = np.zeros(len(drawn))
    for r in points.mapInPandas(weigh, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        weight[r["k"]] = r["n"]
    rng = np.random.default_rng(0)
    centers = [int(weight.argmax())]
    d2 = ((drawn - drawn[centers[0]]) ** 2).sum(1)
    while len(centers) < k:
        p = weight * d2
        p = p if p.sum() > 0 else np.where(np.isin(np.arange(len(drawn)), centers), 0.0, 1.0)
        centers.append(int(rng.choice(len(drawn), p=p / p.sum())))
        d2 = np.minimum(d2, ((drawn - drawn[centers[-1]]) ** 2).sum(1))
    return drawn[centers].tolist()


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, rounds: int = 100, tol: float = 1e-4, centers: Sequence[Sequence[float]] | None = None) -> Model:
    """Lloyd's rounds from k-means|| or given centers. A round is one pass of partial sums; centers without rows move to
    the rows that lie farthest from their own center."""
    d = len(features)
    df = checked(df, features).select(F.array(*doubles(features)).alias("_x")).cache()
    try:
        now = np.array(centers if centers is not None else seeds(df, [F.col("_x")[i] for i in range(d)], k), "f8").reshape(-1, d)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = matrix(batch["_x"], d)
                near, least = _distances(now, x)
                n = np.bincount(near, minlength=len(now))
                total = np.stack([np.bincount(near, x[:, i], len(now)) for i in range(d)], 1)
                on = np.flatnonzero(n)
                far = np.lexsort((*x.T, -least))[: len(now)]
                yield pd.DataFrame({"k": on, "n": n[on], "s": total[on].tolist(), "far": [None] * len(on), "by": np.nan})
                if len(on) < len(now):  # only where centers may be without rows
                    yield pd.DataFrame({"k": -1, "n": 0, "s": None, "far": x[far].tolist(), "by": least[far]})

        kinds = "k long, n long, s array<double>, far array<double>, by double"
        for _ in range(rounds):
            got = df.mapInPandas(sums, kinds)
            found = got.where("k >= 0").groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s")).collect()
            new, there = now.copy(), {r["k"] for r in found}
            for r in found:
                new[r["k"]] = np.array(r["s"]) / r["n"]
            empty = [j for j in range(len(now)) if j not in there]
            if empty:
                far = got.where("k < 0 and by > 0").select("by", "far").distinct().orderBy(F.desc("by"), "far").limit(len(empty)).collect()
                for j, r in zip(empty, far, strict=False):
                    new[j] = r["far"]
            moved = float(np.sqrt(((new - now) ** 2).sum(1)).max())
            now = new
            if moved < tol:
                break
        return Model("kmeans", list(features), {"centers": now.tolist()}, n_samples=df.count())
    finally:
        df.unpersist()


def fuzzy_cmeans(df: DataFrame, features: Sequence[str], k: int = 3, fuzziness: float = 2.0, rounds: int = 100, tol: float = 1e-4, centers: Sequence[Sequence[float]] | None = None) -> Model:
    """Memberships from squared distances to the power 2 / (fuzziness - 1); centers are means weighted by u ** fuzziness."""
    m = fuzziness if fuzziness > 1 else 2.0
    df = checked(df, features).select(*[c.alias(n) for c, n in zip(doubles(features), features, strict=True)]).cache()
    try:
        x = doubles(features)
        now = [list(map(float, c)) for c in centers] if centers is not None else seeds(df, x, k)
        for _ in range(rounds):
            u = memberships(now, x, m)
            w = [F.pow(u[j], F.lit(m)) for j in range(len(now))]
            r = df.agg(*[F.sum(a * c) for a in w for c in x], *[F.sum(a) for a in w]).first()
            d = len(x)
            new = [[r[j * d + i] / r[len(now) * d + j] if r[len(now) * d + j] else now[j][i] for i in range(d)] for j in range(len(now))]
            moved = max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(now, new, strict=True))
            now = new
            if moved < tol:
                break
        return Model("fuzzy_cmeans", list(features), {"centers": now, "fuzziness": m}, n_samples=df.count())
    finally:
        df.unpersist()


def memberships(centers: Sequence[Sequence[float]], x: list[Column], m: float) -> list[Column]:
    """Degree of a row in each cluster; a row that is a center belongs to it alone."""
    d = [squared_distance(c, x) for c in centers]
    hit = first_least(d)
    exact = F.least(*d) <= 0 if len(d) > 1 else d[0] <= 0
    out = []
    for j, dj in enumerate(d):
        total = F.lit(0.0)
        for other in d:
            total = total + F.pow(dj / other, F.lit(2.0 / (m - 1)))
        out.append(F.when(exact, (hit == j).cast("double")).otherwise(1 / total))
    return out


def _block_pairs(tree, d: int, eps: float):
    """For each block the leaves that may hold a row within eps of one of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lo, hi = matrix(batch["lo"], d), matrix(batch["hi"], d)
            of, leaf = tree.within(lo, hi, np.full(len(batch), eps))
            yield pd.DataFrame({"a": batch["block"].to_numpy()[of], "lo": batch["lo"].to_numpy()[of], "hi": batch["hi"].to_numpy()[of], "leaf": leaf.astype("i4")})

    return run


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):  # by differences: exact where coordinates are
        out += (x[:, k, None] - y[None, :, k]) ** 2
    return out


def _within(x: np.ndarray, y: np.ndarray, eps: float, step: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
    """For some rows of x at a time, which rows of y lie within eps: by matrix products, and by differences where these leave a doubt."""
    d = x.shape[1]
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = x - y.mean(0), y - y.mean(0)
        top = np.sqrt(max((a * a).sum(1).max(initial=0), (b * b).sum(1).max(initial=0))) or 1.0
    finite = bool(np.isfinite(top))
    if finite:
        reach = min((eps / top) ** 2, 8.0)
        kind = "f4" if 16 * (d + 4) * np.finfo("f4").eps < 0.02 * reach else "f8"
        slack = 16 * (d + 4) * float(np.finfo(kind).eps)  # of squares at most 4
        a, b = a / top, b / top
        square = (a * a).sum(1)[:, None]
        a, b = np.column_stack([-2 * a, np.ones(len(a))]).astype(kind), np.column_stack([b, (b * b).sum(1)]).astype(kind).T.copy()
    for low in range(0, len(x), step):
        some = slice(low, low + step)
        if not finite:
            yield some, _squares(x[some], y) <= eps * eps
            continue
        product = a[some] @ b
        near = product <= (reach + slack - square[some]).astype(kind)
        row, col = np.nonzero(near & (product > (reach - slack - square[some]).astype(kind)))
        for k in range(0, len(row), 100_000):
            r, c = row[k : k + 100_000], col[k : k + 100_000]
            total = np.zeros(len(r))
            for j in range(d):
                total += (x[some][r, j] - y[c, j]) ** 2
            near[r, c] = total <= eps * eps
        yield some, near


def _near_counts(d: int, eps: float):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"p": pd.Series([], dtype="i8"), "m": pd.Series([], dtype="i8")})
        n = b["n"].to_numpy("i8")
        m = [near @ n for _, near in _within(stacked(a["x"], d), stacked(b["x"], d), eps)]
        return pd.DataFrame({"p": a["p"].to_numpy("i8"), "m": np.concatenate(m)})

    return run


def _near_links(d: int, eps: float):
    """A star for each group of core points of two blocks that nearness connects; points of one node are connected."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series([], dtype="i8"), "b": pd.Series([], dtype="i8")})
        near = np.concatenate([near for _, near in _within(stacked(a["x"], d), stacked(b["x"], d), eps)])
        nodes, of = np.unique(np.concatenate([a["node"].to_numpy("i8"), b["node"].to_numpy("i8")]), return_inverse=True)
        left, right = of[: len(a)], of[len(a) :]
        name = np.arange(len(nodes))
        for _ in range(len(nodes)):
            least = np.where(near, name[right][None], len(nodes)).min(1)
            new = name.copy()
            np.minimum.at(new, left, least)
            least = np.where(near, new[left][:, None], len(nodes)).min(0)
            np.minimum.at(new, right, least)
            if (new == name).all():
                break
            name = new
        far = name != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[name[far]], "b": nodes[far]})

    return run


def _near_cores(d: int, eps: float):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"p": pd.Series([], dtype="i8"), "cluster": pd.Series([], dtype="i8")})
        cluster, none = b["cluster"].to_numpy("i8"), np.iinfo("i8").max
        least = np.concatenate([np.where(near, cluster[None], none).min(1) for _, near in _within(stacked(a["x"], d), stacked(b["x"], d), eps)])
        return pd.DataFrame({"p": a["p"].to_numpy("i8"), "cluster": least})[least < none]

    return run


#: Rows of a group where large groups meet, fewest groups, rows of a group that only counts within itself, and hubs.
GROUP, GROUPS, OWN, HUBS = 50_000, 8, 4096, 1024


def _met(small: DataFrame, large: DataFrame, run, schema: str) -> DataFrame:
    """`run` on all pairs of groups of two tables of points, dealt by p."""
    a, b = max(1, -(-small.count() // GROUP)), max(GROUPS, -(-large.count() // GROUP))
    deal = lambda n: F.pmod(F.xxhash64("p"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    small = small.select("*", deal(a).alias("a"), copies(b).alias("b"))
    large = large.select(*[F.col(c).alias(c) for c in large.columns], copies(a).alias("a"), deal(b).alias("b"))
    return small.groupBy("a", "b").cogroup(large.groupBy("a", "b")).applyInPandas(run, schema)


def _own_counts(d: int, eps: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, n = stacked(group["x"], d), group["n"].to_numpy("i8")
        return group.assign(m=np.concatenate([near @ n for _, near in _within(x, x, eps)]))[["p", "x", "n", "m"]]

    return run


def _hub_links(d: int, eps: float, hubs: np.ndarray, names: np.ndarray):
    """A link of every core point to its first hub, and links of the hubs that a core point connects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beside = np.zeros((len(hubs), len(hubs)), bool)
        for batch in batches:
            if not len(batch):
                continue
            p = batch["p"].to_numpy("i8")
            for some, near in _within(stacked(batch["x"], d), hubs, eps):
                row = np.flatnonzero(near.any(1))
                first = near[row].argmax(1)
                yield pd.DataFrame({"a": names[first], "b": p[some][row]})
                order = np.argsort(first, kind="stable")
                if len(order):
                    which, at = np.unique(first[order], return_index=True)
                    beside[which] |= np.logical_or.reduceat(near[row[order]], at, axis=0)
        i, j = np.nonzero(beside)
        yield pd.DataFrame({"a": names[i[i != j]], "b": names[j[i != j]]})

    return run


def _node_links(d: int, eps: float):
    """Different nodes of which points are near each other."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), "i8")]
        if len(a) and len(b):
            left, right = a["node"].to_numpy("i8"), b["node"].to_numpy("i8")
            names, of = np.unique(right, return_inverse=True)
            for some, near in _within(stacked(a["x"], d), stacked(b["x"], d), eps):
                row, col = np.nonzero(near)
                pairs = np.unique(row * len(names) + of[col])
                pairs = np.column_stack([left[some][pairs // len(names)], names[pairs % len(names)]])
                found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        found = np.concatenate(found)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return run


def _by_hubs(points: DataFrame, d: int, eps: float, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Clusters of the points (p, x, n) where boxes skip little: core points (p, cluster), and border points.

    A point that has enough neighbours in its own group of OWN rows is a core point; only others are counted against all.
    Core points near a common hub, one of HUBS of them, are connected; only those that the largest group so made doesn't
    hold are compared with all core points, as are the border points. In dense tables these are few; at worst, all pairs
    of groups of GROUP rows are compared, by matrix products.
    """
    own = F.pmod(F.xxhash64("p"), F.lit(-(-points.count() // OWN)))
    counted = stored(points.select("p", "x", "n", own.alias("g")).groupBy("g").applyInPandas(_own_counts(d, eps), "p long, x array<double>, n long, m long"))
    doubt = counted.where(F.col("m") < min_points).select("p", "x")
    exact = _met(doubt, counted.select("p", "x", "n"), _near_counts(d, eps), "p long, m long").groupBy("p").agg(F.sum("m").alias("m"))
    more = stored(exact.where(F.col("m") >= min_points).select("p", F.lit(True).alias("also")))
    counted = stored(counted.join(more, "p", "left").select("p", "x", ((F.col("m") >= min_points) | F.col("also").isNotNull()).alias("core")))
    core = counted.where("core").select("p", "x")
    some = core.orderBy(F.xxhash64("p"), "p").limit(HUBS).collect()
    if some:
        links = core.mapInPandas(_hub_links(d, eps, np.array([r.x for r in some], "f8"), np.array([r.p for r in some], "i8")), "a long, b long")
        found = components(links.where("a <> b").distinct())
        core = stored(core.join(found.withColumnRenamed("node", "p"), "p", "left").select("p", "x", F.coalesce("component", "p").alias("node")))
        largest = core.groupBy("node").count().orderBy(F.desc("count"), "node").first()[0]
        links = _met(core.where(F.col("node") != largest), core, _node_links(d, eps), "a long, b long")
        found = components(links.distinct())
        core = stored(core.join(found, "node", "left").select("p", "x", F.coalesce("component", "node").alias("cluster")))
    else:
        core = core.withColumn("cluster", F.col("p"))
    border = _met(counted.where("not core").select("p", "x"), core, _near_cores(d, eps), "p long, cluster long")
    return core.select("p", "cluster"), border.groupBy("p").agg(F.min("cluster").alias("cluster"))


def dbscan(df: DataFrame, features: Sequence[str], row_id: str, eps: float = 0.5, min_points: int = 5, rows: int = 1024, sent: int = 500_000) -> DataFrame:
    """row_id, cluster (its smallest core row's id, or null for noise), core; of any number of features.

    Equal points fold into one with a count. A k-d split deals the points into blocks of about `rows`, each with its box.
    Pairs of blocks whose boxes lie further than eps apart never meet. In pairs whose boxes lie within eps as a whole all
    points are neighbours, and neither counting nor linking looks at points: dense regions cost a row per pair of blocks.
    Other pairs are compared in a task that holds two blocks; to count, only where that decides anything. A point counts
    among its own neighbours. Border points join their smallest cluster. Where such pairs would be over an eighth of all and
    send over `sent` points, hubs connect the points instead.
    """
    x, d = doubles(features), len(features)
    given = checked(df, features, row_id).select(F.col(row_id).cast("long").alias("id"), F.array(*x).alias("x"))
    points = cut(given.groupBy("x").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("n")))
    tree = fit(points, d, points.count(), rows)
    points, _ = blocked(points, tree, d, rows, "p")
    points = cut(points)
    blocks = cut(points.groupBy("block", "leaf").agg(F.sum("n").alias("weight"), *corners(d)))
    meet = blocks.select("block", "lo", "hi").mapInPandas(_block_pairs(tree, d, eps), "a long, lo array<double>, hi array<double>, leaf int")
    other = blocks.select("leaf", F.col("block").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    square = lambda f: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), f), F.lit(0.0), lambda s, v: s + v * v)
    apart = square(lambda k: F.greatest(F.col("lo")[k] - F.col("hi2")[k], F.col("lo2")[k] - F.col("hi")[k], F.lit(0.0)))
    across = square(lambda k: F.greatest(F.col("hi")[k] - F.col("lo2")[k], F.col("hi2")[k] - F.col("lo")[k]))
    pairs = cut(meet.join(other, "leaf").where(apart <= eps * eps * (1 + 1e-9)).select("a", "b", (across <= eps * eps * (1 - 1e-12)).alias("full")))
    partial, many = pairs.where("not full").count(), blocks.count()
    if partial > many * many / 8 and partial * rows > sent:
        core, border = _by_hubs(points.select("p", "x", "n"), d, eps, min_points)
        placed = core.withColumn("core", F.lit(True)).union(border.withColumn("core", F.lit(False)))
        out = given.join(points.select("x", "p"), "x").join(placed, "p", "left")
        return out.select(F.col("id").alias(row_id), "cluster", F.coalesce("core", F.lit(False)).alias("core"))
    # counting
    sure = pairs.where("full").join(blocks.select(F.col("block").alias("b"), "weight"), "b").groupBy(F.col("a").alias("block")).agg(F.sum("weight").alias("sure"))
    points = cut(points.join(sure, "block", "left").withColumn("sure", F.coalesce("sure", F.lit(0).cast("long"))))
    partly = pairs.where("not full").select("a", "b")

    def sides(p: DataFrame, q: DataFrame):
        """Each side's points, once for every block of the other side that they may be near to; with columns of their own."""
        p = p.join(partly.withColumnRenamed("a", "block"), "block").withColumnRenamed("block", "a")
        q = q.join(partly.withColumnRenamed("b", "block"), "block").withColumnRenamed("block", "b")
        return [side.select(*[F.col(c).alias(c) for c in side.columns]).groupBy("a", "b") for side in (p, q)]

    left, right = sides(points.where(F.col("sure") < min_points).select("p", "x", "block"), points.select("x", "n", "block"))
    counted = left.cogroup(right).applyInPandas(_near_counts(d, eps), "p long, m long").groupBy("p").agg(F.sum("m").alias("m"))
    points = points.join(counted, "p", "left").withColumn("core", F.col("sure") + F.coalesce("m", F.lit(0)) >= min_points)
    points = cut(points.select("p", "x", "block", "core"))
    # linking: where a block's core points have a neighbour in common, they are one node
    core = points.where("core")
    heads = cut(core.groupBy("block").agg(F.min("p").alias("head")))
    whole = pairs.where("full").join(heads.select(F.col("block").alias("b"), F.col("head").alias("other")), "b").join(heads.withColumnRenamed("block", "a"), "a")
    whole = cut(whole.select("a", "head", "other"))
    node = F.coalesce("head", "p").alias("node")
    core = cut(core.join(whole.select(F.col("a").alias("block"), "head").distinct(), "block", "left").select("p", "x", "block", node))
    left, right = sides(core.select("x", "node", "block"), core.select("x", "node", "block"))
    links = left.cogroup(right).applyInPandas(_near_links(d, eps), "a long, b long")
    links = links.union(whole.select(F.col("head").alias("a"), F.col("other").alias("b")))
    # a head that stands for a block in `whole` may itself be no node of its own where that block has none in common
    links = links.union(core.where("p <> node").select(F.col("node").alias("a"), F.col("p").alias("b")))
    found = components(links)
    core = cut(core.join(found.select(F.col("node").alias("p"), "component"), "p", "left").select("p", "x", "block", F.coalesce("component", "p").alias("cluster")))
    # border points
    rest = points.where("not core").select("p", "x", "block")
    left, right = sides(rest, core.select("x", "cluster", "block"))
    near = left.cogroup(right).applyInPandas(_near_cores(d, eps), "p long, cluster long")
    beside = pairs.where("full").join(core.groupBy(F.col("block").alias("b")).agg(F.min("cluster").alias("cluster")), "b").select(F.col("a").alias("block"), "cluster")
    border = near.union(rest.select("p", "block").join(beside, "block").select("p", "cluster")).groupBy("p").agg(F.min("cluster").alias("cluster"))
    placed = core.select("p", "cluster", F.lit(True).alias("core")).union(border.select("p", "cluster", F.lit(False)))
    out = given.join(points.select("x", "p"), "x").join(placed, "p", "left")
    return out.select(F.col("id").alias(row_id), "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def dbscan_model(df: DataFrame, clustered: DataFrame, features: Sequence[str], row_id: str) -> Model:
    """Means and sizes of the clusters, to place other rows by the nearest mean; `mse` holds the share of noise."""
    both = df.join(clustered, row_id)
    rows = both.where("cluster is not null").groupBy("cluster").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features], F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()
    n, noise = both.agg(F.count(F.lit(1)), F.count_if(F.col("cluster").isNull())).first()
    return Model("dbscan", list(features), {"centers": [[r[f] for f in features] for r in rows], "sizes": [r["n"] for r in rows]}, mse=noise / n if n else None, n_samples=n)


def dbscan_train(df: DataFrame, features: Sequence[str], eps: float = 0.5, min_points: int = 5) -> Model:
    """Clusters of the rows as a model that places other rows by the nearest mean."""
    rows = cut(checked(df, features).select(*[c.alias(f) for c, f in zip(doubles(features), features, strict=True)]).withColumn("_row", F.monotonically_increasing_id()))
    return dbscan_model(rows, dbscan(rows, features, "_row", eps, min_points), features, "_row")


def agglomerative(df: DataFrame, features: Sequence[str], k: int = 3, linkage: str = "complete", most: int = 400) -> Model:
    """Greedy merging on squared distances, single, complete or average.

    Single linkage of one feature takes any table: its groups end at the k - 1 widest gaps between neighbouring values.
    So does average linkage: over `most` distinct rows its merges are found in rounds (but for ties, they are the same).
    Single linkage of several features cuts the minimum spanning tree. Complete linkage needs the distances of all pairs on the driver; over `most` distinct rows it's refused.
    """
    x = doubles(features)
    df = checked(df, features)
    points = df.groupBy(*[c.alias(n) for c, n in zip(x, features, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    if linkage == "single" and len(features) == 1:
        return _by_gaps(points, features[0], k)
    some = points.orderBy(*features).limit(most + 1).collect()
    if len(some) > most and linkage != "complete":
        return (_by_reciprocal if linkage == "average" else _by_tree)(points, features, k)
    if len(some) > most:
        raise ValueError(f"{linkage} linkage of {len(features)} features compares all pairs and takes at most {most} distinct rows; raise `most` or gather the rows first")
    p, size = np.array([[r[f] for f in features] for r in some], "f8"), np.array([r["n"] for r in some], "f8")
    if not len(p) or not 1 <= k <= len(p):
        raise ValueError(f"k must be from 1 to {len(p)}")
    dist = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    groups, weight = [[i] for i in range(len(p))], size.copy()
    alive = list(range(len(p)))
    while len(alive) > k:
        sub = dist[np.ix_(alive, alive)]
        i, j = (alive[v] for v in divmod(int(sub.argmin()), len(alive)))
        i, j = min(i, j), max(i, j)
        if linkage == "single":
            row = np.minimum(dist[i], dist[j])
        elif linkage == "complete":
            row = np.maximum(dist[i], dist[j])
        else:
            row = (weight[i] * dist[i] + weight[j] * dist[j]) / (weight[i] + weight[j])
        dist[i], dist[:, i] = row, row
        dist[i, i] = np.inf
        groups[i] += groups[j]
        weight[i] += weight[j]
        alive.remove(j)
    centers = [np.average(p[groups[a]], axis=0, weights=size[groups[a]]).tolist() for a in alive]
    return Model("agglomerative", list(features), {"centers": centers}, n_samples=df.count())


def _by_reciprocal(points: DataFrame, features: Sequence[str], k: int) -> Model:
    """Average linkage of distinct points with counts `n`, by rounds of reciprocal nearest groups.

    The mean squared distance of two groups is that of their means plus both groups' mean squared deviations, so that a
    group is a point with one feature more, its nearest group is a nearest neighbour, and no distances are kept. Two groups
    that are nearest to each other are merged at once, all such pairs in one round: the order changes no merge. The whole
    tree is built, and its total - k lowest merges count.
    """
    d = len(features)
    names = [f"c{i}" for i in range(d + 1)]
    rows = stored(points.select(F.monotonically_increasing_id().alias("id"), F.array(*features).alias("x"), F.col("n").cast("double").alias("w"), F.lit(0.0).alias("v")))
    total = rows.count()
    if not 1 <= k <= total:
        raise ValueError(f"k must be from 1 to {total}")
    now, merges, turn = rows, None, 0
    while total > k and now.count() > 1:
        at = [F.col("x")[i].alias(f"c{i}") for i in range(d)]
        near = nearest(now.select("id", *at, F.sqrt("v").alias(f"c{d}")), now.select("id", *at, F.lit(0.0).alias(f"c{d}")), names, 1, "id", "id", skip_self=True)
        near = stored(near.select(F.col("qid").alias("a"), F.col("tid").alias("b"), "distance"))
        pairs = near.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").where("a < b").select("a", "b")
        if pairs.isEmpty():  # rounding may hide the least pair from one of its two
            least = near.join(now.select(F.col("id").alias("a"), "v"), "a").orderBy(F.col("distance") * F.col("distance") + F.col("v"), "a", "b").limit(1)
            pairs = least.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = stored(pairs)
        one, two = (now.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in "xwv"]) for side in "ab")
        both = pairs.join(one, "a").join(two, "b").withColumn("gap", F.aggregate(F.zip_with("x_a", "x_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        w = F.col("w_a") + F.col("w_b")
        both = both.select("a", "b", (F.col("gap") + F.col("v_a") + F.col("v_b")).alias("height"), F.zip_with("x_a", "x_b", lambda p, q: (p * F.col("w_a") + q * F.col("w_b")) / w).alias("x"), w.alias("w"), ((F.col("w_a") * F.col("v_a") + F.col("w_b") * F.col("v_b") + F.col("gap") * F.col("w_a") * F.col("w_b") / w) / w).alias("v"))
        both = stored(both)
        more = both.select("a", "b", "height", F.lit(turn).alias("turn"))
        merges = more if merges is None else merges.union(more)
        alone = now.join(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), "id", "left_anti")
        now, turn = stored(alone.select("id", "x", "w", "v").union(both.select(F.col("a").alias("id"), "x", "w", "v"))), turn + 1
    named = rows
    if merges is not None:
        low = components(merges.orderBy("height", "turn", "a").limit(total - k).select("a", "b"))
        named = rows.join(low.withColumnRenamed("node", "id"), "id", "left").withColumn("id", F.coalesce("component", "id"))
    means = named.groupBy("id").agg(*[(F.sum(F.col("x")[i] * F.col("w")) / F.sum("w")).alias(f"c{i}") for i in range(d)], F.sum("w").alias("w")).orderBy("id").collect()
    return Model("agglomerative", list(features), {"centers": [[r[f"c{i}"] for i in range(d)] for r in means]}, n_samples=int(sum(r["w"] for r in means)))


def _least_links(d: int):
    """Of each component in `a`, the shortest link to a point of another one in `b`; of equals the one of least ids."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("comp", "gap", "p", "q")}
        if len(a) and len(b):
            a, b = a.sort_values("id"), b.sort_values("id")
            y, other, ids = matrix(b["x"], d), b["comp"].to_numpy("i8"), b["id"].to_numpy("i8")
            best = {}
            for low in range(0, len(a), 256):
                some = a.iloc[low : low + 256]
                comp = some["comp"].to_numpy("i8")
                gap = _squares(matrix(some["x"], d), y)
                gap[comp[:, None] == other[None]] = np.inf
                least = gap.min(1)
                for i in np.flatnonzero(np.isfinite(least)):
                    at = ids[np.flatnonzero(gap[i] == least[i])]
                    links = np.sort(np.column_stack([np.full(len(at), some["id"].iloc[i]), at]), axis=1)
                    link = (least[i], *links[np.lexsort((links[:, 1], links[:, 0]))[0]])
                    if comp[i] not in best or link < best[comp[i]]:
                        best[comp[i]] = link
            out = {"comp": list(best), "gap": [v[0] for v in best.values()], "p": [v[1] for v in best.values()], "q": [v[2] for v in best.values()]}
        return pd.DataFrame(out).astype({"comp": "i8", "gap": "f8", "p": "i8", "q": "i8"})

    return run


def _surely_within(leaves: pd.DataFrame, d: int):
    """For the part of a component in a box: a distance within which some box holds a point of another component."""
    lo, hi, first, last = matrix(leaves["lo"], d), matrix(leaves["hi"], d), leaves["first"].to_numpy("i8"), leaves["last"].to_numpy("i8")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bound = []
            for a, b, c in zip(matrix(batch["lo"], d), matrix(batch["hi"], d), batch["comp"], strict=True):
                far = np.maximum(np.maximum(hi - a, b - lo), 0)
                far = (far * far).sum(1)[(first != c) | (last != c)]
                bound.append(far.min() if len(far) else np.inf)
            yield pd.DataFrame({"comp": batch["comp"].to_numpy("i8"), "bound": np.array(bound, "f8")})

    return run


def _by_tree(points: DataFrame, features: Sequence[str], k: int, rows: int = 1024) -> Model:
    """Single linkage of distinct points with counts `n`: its merges are the edges of the minimum spanning tree.

    The tree grows by Boruvka's rounds: every component takes its shortest link to another one, which at least halves
    them. Points lie in the blocks of a k-d split; a component's link can't be longer than the best inside its blocks, nor
    than the way across to the nearest box that holds another component, and only blocks nearer than that meet. Links are
    ordered by length and ids, so that equal ones close no circle; the total - k shortest edges are merged.
    """
    d = len(features)
    pts = stored(points.select(F.monotonically_increasing_id().alias("id"), F.array(*features).alias("x"), "n"))
    total = pts.count()
    if not 1 <= k <= total:
        raise ValueError(f"k must be from 1 to {total}")
    tree = fit(pts, d, total, rows)
    pts, _ = blocked(pts, tree, d, rows, "id")
    pts = stored(pts)
    blocks = stored(pts.groupBy("block", "leaf").agg(*corners(d)))
    other = blocks.select("leaf", F.col("block").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    square = lambda f: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), f), F.lit(0.0), lambda s, v: s + v * v)
    apart = square(lambda i: F.greatest(F.col("lo")[i] - F.col("hi2")[i], F.col("lo2")[i] - F.col("hi")[i], F.lit(0.0)))
    now = pts.select("id", "x", "block", "leaf", F.col("id").alias("comp"))
    kinds, edges, left = "comp long, gap double, p long, q long", None, total
    fresh = lambda side: side.select(*[F.col(c).alias(c) for c in side.columns])

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of, leaf = tree.within(matrix(batch["lo"], d), matrix(batch["hi"], d), np.sqrt(batch["bound"].to_numpy("f8")))
            yield batch.iloc[of].assign(leaf=leaf.astype("i4"))[["a", "comp", "lo", "hi", "bound", "leaf"]]

    while left > 1:
        some = now.select("id", "x", "comp", "block")
        inside = stored(fresh(some).groupBy("block").cogroup(fresh(some).groupBy("block")).applyInPandas(_least_links(d), kinds))
        leaves = now.groupBy("leaf").agg(*corners(d), F.min("comp").alias("first"), F.max("comp").alias("last")).toPandas()  # at most 16,384
        parts = stored(now.groupBy("block", "comp").agg(*corners(d)))
        bound = parts.mapInPandas(_surely_within(leaves, d), "comp long, bound double").union(inside.select("comp", "gap")).groupBy("comp").agg(F.min("bound").alias("bound"))
        asked = parts.join(bound, "comp").withColumnRenamed("block", "a").select("a", "comp", "lo", "hi", "bound")
        met = asked.mapInPandas(reached, "a long, comp long, lo array<double>, hi array<double>, bound double, leaf int")
        met = stored(met.join(other, "leaf").where((apart <= F.col("bound") * (1 + 1e-9)) & (F.col("a") != F.col("b"))).select("a", "comp", "b"))
        one = some.withColumnRenamed("block", "a").join(met, ["a", "comp"]).select("id", "x", "comp", "a", "b")
        two = some.withColumnRenamed("block", "b").join(met.select("a", "b").distinct(), "b").select("id", "x", "comp", "a", "b")
        between = fresh(one).groupBy("a", "b").cogroup(fresh(two).groupBy("a", "b")).applyInPandas(_least_links(d), kinds)
        links = inside.union(between).groupBy("comp").agg(F.min(F.struct("gap", "p", "q")).alias("e")).select("e.*").distinct()
        links = stored(links)
        edges = links if edges is None else edges.union(links)
        found = components(edges.select(F.col("p").alias("a"), F.col("q").alias("b")))
        now = stored(pts.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "x", "block", "leaf", F.coalesce("component", "id").alias("comp")))
        left = now.select("comp").distinct().count()
    named = pts.withColumn("comp", F.col("id"))
    if edges is not None and total > k:
        low = components(edges.orderBy("gap", "p", "q").limit(total - k).select(F.col("p").alias("a"), F.col("q").alias("b")))
        named = pts.join(low.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    means = named.groupBy("comp").agg(*[(F.sum(F.col("x")[i] * F.col("n")) / F.sum("n")).alias(f"c{i}") for i in range(d)], F.sum("n").alias("n")).orderBy("comp").collect()
    return Model("agglomerative", list(features), {"centers": [[r[f"c{i}"] for i in range(d)] for r in means]}, n_samples=int(sum(r["n"] for r in means)))


def _by_gaps(points: DataFrame, feature: str, k: int) -> Model:
    """Single linkage of distinct values with counts `n`; of equal gaps the lower are merged first."""
    points = points.select(F.col(feature).alias("v"), "n").cache()
    try:
        values, rows = points.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not values or not 1 <= k <= values:
            raise ValueError(f"k must be from 1 to {values}")
        gaps = with_next(points, "v").where("next is not null")
        gap = (F.col("next") - F.col("v")) * (F.col("next") - F.col("v"))
        ends = sorted(r.v for r in gaps.orderBy(gap.desc(), F.desc("v")).limit(k - 1).collect()) if k > 1 else []
        group = F.aggregate(F.array(*[F.lit(e) for e in ends]), F.lit(0), lambda a, e: a + F.when(F.col("v") > e, 1).otherwise(0)) if ends else F.lit(0)
        found = points.groupBy(group.alias("g")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("center")).collect()
        return Model("agglomerative", [feature], {"centers": [[r.center] for r in sorted(found, key=lambda r: r.g)]}, n_samples=rows)
    finally:
        points.unpersist()
