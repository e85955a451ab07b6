"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the distinct hashes of its word shingles. Documents of equal sets form a class; classes join.

1. Order. All tokens have one global order, frequent ones last. A distributed count of tokens that recur gives a hint
   of how frequent they are, kept in a table of fixed size; tokens order by being in it, and then by hash. Results don't
   depend on the hint.
2. Index. For Jaccard t, a set of n tokens overlaps any partner in at least ceil(t n) of them, so the first
   n - ceil(t n) + 1 tokens of both in the global order share one. Only these are listed, and lists of one class go.
3. Adaptive prefix. The counted frequencies of a class's listed tokens add up to the candidates to be expected. A prefix
   longer by l - 1 tokens lets a pair through only with l shared tokens of it rather than one; l minimises the estimated
   cost of carrying the prefix and of verifying the candidates that l shared tokens leave. In terms of counts, with o
   shared prefix tokens and r tokens left behind the prefix that ends first: o + r must reach the overlap that the pair
   needs.
4. Short lists make pairs by a join on the token, and shared tokens are counted per pair. Lists of more than `crowd`
   classes, or a quarter of that for short sets (families of near copies), are dealt into blocks and compared block by block inside a task, from the classes'
   prefixes; a pair belongs to the first crowded list that both are in, and only pairs that can still reach the overlap leave
   the task. A pair of a crowded list is always judged there, whatever its short lists say.
5. Families, an addition to the method, come before that, as their pairs grow with the square of their size: classes with at least half of their listed
   tokens in crowded lists meet in the largest of those, dealt into blocks, with their whole sets; a block gives one star per
   group of linked classes. Step 4 then takes only crowded lists, and pairs in them, that no family connects yet.
6. The pairs left are verified on their whole sets, and linked classes are joined by connected components.

Defined cases: null, empty and white-space texts have an empty set and link with nothing; texts of fewer words than a
shingle have the whole sequence as their one shingle; rows that share a doc_id are one node, its links pooled; rows
with a null doc_id link with nothing and have a null component_id; an empty table gives no rows; columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, keyed
from .spans import BYTES, NOT_SPACE, blocks, hashes, mix, runs, slices, sums

_U = np.uint64
HOT = 62
TABLE_BITS = 24
#: At most so many frequent tokens enter the table (a hint of order and cost only).
HINTS = 400_000
#: Cost model of a prefix: verifying one token of a candidate costs 1, carrying one token of a prefix to the blocks CARRY;
#: of the candidates that share l tokens of a prefix, so many share l + 1.
CARRY, KEEP = 100.0, 0.95
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], "u1")


def shingles(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of rows: the first row, shingle hashes in 62 bits (with repeats), and each row's first (n + 1)."""
    for first_row, _last, data, offsets in blocks(column):
        starts, ends, first = runs(NOT_SPACE[data], offsets)
        words = hashes(sums(BYTES[LOWER[data]]), starts, ends)
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
        at = np.concatenate([[0], np.cumsum(count)])
        begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
        end = begin + np.repeat(np.minimum(n, width), count)
        yield first_row, hashes(sums(words), begin, end) >> _U(2), at


def sets(column: pa.Array, width: int, marks: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Each row's set, ascending in the global order."""
    for _, h, at in shingles(column, width):
        if marks is not None:
            h = h | ((marks[h >> _U(62 - TABLE_BITS)] > 0).astype("u8") << _U(HOT))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            x = np.sort(h[a:b])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a else x


def set_name(x: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    plain = x & _U((1 << HOT) - 1)
    a, b = int(mix(plain).sum()), int(mix(plain ^ _U(0x5555)).sum())
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _recurring(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = np.sort(np.concatenate([h for _, h, _ in shingles(batch.column("text"), width)] or [np.zeros(0, "u8")]))
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, "i8")
            n = np.diff(edge)
            often = n >= least
            yield pa.RecordBatch.from_pydict({"t": pa.array(h[edge[:-1][often]].view("i8")), "n": pa.array(n[often])})

    return run


def _names(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(len(x), *set_name(x)) if len(x) else (0, 0, 0) for x in sets(batch.column("text"), width)]
            n, a, b = (np.array(v, "i8") for v in zip(*found, strict=True)) if found else [np.zeros(0, "i8")] * 3
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n), "c": pa.array(a), "c2": pa.array(b)})

    return run


class Rule:
    """Sizes that follow from the threshold, as whole per cents."""

    def __init__(self, percent: int):
        self.percent = percent

    def base(self, n: int) -> int:
        return n + (-self.percent * n) // 100 + 1

    def longer(self, x: np.ndarray, classes: np.ndarray) -> int:
        """Length of the compared prefix, by estimated cost. `classes`: logarithms of the frequent tokens' counts."""
        n, p = len(x), self.base(len(x))
        often = x[:p][x[:p] >> _U(HOT) > 0] & _U((1 << HOT) - 1)
        candidates = float(np.exp2(classes[often >> _U(62 - TABLE_BITS)].astype("f8")).sum())
        if not candidates:
            return p
        # the minimum over l of CARRY * (p + l - 1) + candidates * n * KEEP ** (l - 1)
        more = np.log(candidates * n * -np.log(KEEP) / CARRY) / -np.log(KEEP)
        return min(n, p + int(np.clip(more, 0, n // 4)))

    def need(self, n, m):
        return -((-self.percent * (n + m)) // (100 + self.percent))


def _index(width: int, rule: Rule, marks: bytes):
    """A row for each listed token: token, class, size, listed length and last listed token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(zlib.decompress(marks), "u1")
        for batch in slices(batches):
            seen, out = set(), []
            for x in sets(batch.column("text"), width, classes):
                if len(x) and (name := set_name(x)[0]) not in seen:
                    seen.add(name)
                    out.append((name, len(x), x[: rule.base(len(x))]))
            size = np.array([len(x) for _, _, x in out], "i8")
            spread = lambda v, kind: pa.array(np.repeat(np.array(v, kind), size))
            yield pa.RecordBatch.from_pydict({
                "t": pa.array(np.concatenate([x for _, _, x in out]).view("i8") if out else np.zeros(0, "i8")),
                "c": spread([c for c, _, _ in out], "i8"),
                "n": spread([n for _, n, _ in out], "i4"),
                "last": spread([x[-1] for _, _, x in out], "i8"),
            })

    return run


def _prefixes(width: int, rule: Rule, marks: bytes):
    """The compared prefix of every class whose listed tokens include frequent ones, and of all others the listed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(zlib.decompress(marks), "u1")
        for batch in slices(batches):
            seen, out = set(), []
            for x in sets(batch.column("text"), width, classes):
                if len(x) and (name := set_name(x)[0]) not in seen:
                    seen.add(name)
                    out.append((name, x[: rule.longer(x, classes)]))
            yield pa.RecordBatch.from_pydict({
                "c": pa.array([c for c, _ in out], pa.int64()),
                "end": pa.array([int(x[-1]) for _, x in out], pa.int64()),
                "prefix": pa.array([x.astype("<u8").tobytes() for _, x in out], pa.binary()),
            })

    return run


def _shared(rows: list[np.ndarray]) -> np.ndarray:
    """Tokens that each two sets share: all pairs at once, by some thousand tokens at a time."""
    _, at, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    row_of = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    common = times[at] > 1
    at, row_of = (np.cumsum(times > 1) - 1)[at[common]], row_of[common]
    order = np.argsort(at, kind="stable")
    at, row_of = at[order], row_of[order]
    shared = np.zeros((len(rows), len(rows)), "f4")
    for low in range(0, int((times > 1).sum()), 4096):
        some = slice(*np.searchsorted(at, [low, low + 4096]))
        wide = np.zeros((len(rows), 4096), "f4")
        wide[row_of[some], at[some] - low] = 1
        shared += wide @ wide.T
    return shared


def _family(rule: Rule):
    """A star for each group of two or more classes of a block that links connect."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        c, rows = group["c"].to_numpy(), [np.frombuffer(x, "<u8") for x in group["x"]]
        n, o = np.array([len(x) for x in rows]), _shared(rows).astype("i8")
        linked = 100 * o >= rule.percent * (n[:, None] + n[None] - o)
        head = np.full(len(c), -1)
        for i in range(len(c)):
            front = np.array([i]) if head[i] < 0 else np.zeros(0, int)
            while len(front):
                head[front] = i
                front = np.flatnonzero(linked[front].any(0) & (head < 0))
        far = head != np.arange(len(c))
        return pd.DataFrame({"a": np.minimum(c, c[head])[far], "b": np.maximum(c, c[head])[far]})

    return run


def _crowd(rule: Rule):
    """Pairs of a block of a crowded list that can still reach the overlap that they need."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        t, i, j = (int(group[k].iloc[0]) for k in ("t", "i", "j"))
        group = group.sort_values(["n", "c"])
        c, n, side, end, family = (group[k].to_numpy() for k in ("c", "n", "side", "end", "family"))
        rows = [np.frombuffer(x, "<u8") for x in group["prefix"]]
        p = np.array([len(x) for x in rows])
        shared = _shared(rows)
        rest = np.where(end[:, None] <= end[None], (n - p)[:, None], (n - p)[None])
        ok = (shared + rest >= rule.need(n[:, None], n[None])) & (100 * np.minimum(n[:, None], n[None]) >= rule.percent * np.maximum(n[:, None], n[None]))
        ok &= np.triu(np.ones_like(ok), 1) if i == j else (side[:, None] == i) & (side[None] == j)
        a, b = np.nonzero(ok & (family[:, None] != family[None]))
        ts = [np.sort(x) for x in group["ts"]]
        mine = np.array([np.intersect1d(ts[x], ts[y], assume_unique=True)[0] == t for x, y in zip(a, b, strict=True)], bool)
        a, b = a[mine], b[mine]
        return pd.DataFrame({"a": np.minimum(c[a], c[b]), "b": np.maximum(c[a], c[b])})

    return run


def _verify(rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                o = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * o >= rule.percent * (len(x) + len(y) - o))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x for x in sets(batch.column("text"), width) if len(x)]
            yield pa.RecordBatch.from_pydict({"c": pa.array([set_name(x)[0] for x in found], pa.int64()), "x": pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())})

    return run


def _sets_of(rows: DataFrame, named: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """c, x: the whole set of each wanted class, from the text of one of its rows."""
    first = named.where("n > 0").join(wanted, "c", "left_semi").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    # an id that several texts share brings sets of other classes, which are dropped or themselves wanted
    texts = rows.join(first.select("doc_id").distinct(), "doc_id").mapInArrow(_whole(width), "c long, x binary").join(wanted, "c", "left_semi")
    return texts.groupBy("c").agg(F.first("x").alias("x"))


def _families(rows: DataFrame, named: DataFrame, many: DataFrame, rule: Rule, width: int, block: int, tokens: int = 1 << 20, deals: int = 2) -> DataFrame:
    """Stars a < b of classes that links connect, of most families of near copies. `many`: t, c, n, k of crowded lists.

    Blocks hold about `block` classes and `tokens` tokens. A family of several blocks comes out in parts; each further deal
    puts the parts that are left into other blocks. What is never joined here costs more pairs later, no links.
    """
    half = F.expr(f"2 * count(*) >= n - ({rule.percent} * n + 99) div 100 + 1")
    member = many.groupBy("c", "n").agg(half.alias("half"), F.max(F.struct("k", "t")).alias("top")).where("half").select("c", "n", "top.t")
    size = member.groupBy("t").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / tokens)).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    member = cut(member.join(size, "t").select("t", "c", "blocks"))
    member = cut(member.join(_sets_of(rows, named, member.select("c"), width), "c"))
    stars = None
    for deal in range(deals):
        some = member
        if stars is not None:
            some = member.where("blocks > 1").join(components(stars).select(F.col("node").alias("c"), "component"), "c", "left").withColumn("family", F.coalesce("component", "c"))
            apart = some.groupBy("t").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("t")
            some = some.join(apart, "t", "left_semi")
        some = some.withColumn("i", F.pmod(F.xxhash64("c", F.lit(deal)), "blocks"))
        found = cut(some.select("t", "i", "c", "x").groupBy("t", "i").applyInPandas(_family(rule), "a long, b long"))
        stars = found if stars is None else stars.union(found)
    return stars


def links(docs: DataFrame, percent: int = 85, width: int = 4, crowd: int = 64, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, n, c (its class); and pairs of classes a < b with the same components as all links.

    The pairs are links, but for those of families, which are stars over classes that links connect.
    """
    rule = Rule(percent)
    rows = keyed(docs).select("doc_id", "text")
    named = cut(rows.mapInArrow(_names(width), "doc_id long, n long, c long, c2 long"))
    often = rows.mapInArrow(_recurring(width, 3), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where("n >= 24")
    hot = often.orderBy(F.desc("n"), "t").limit(HINTS).select(F.shiftright("t", HOT - TABLE_BITS).cast("int"), F.log2("n").cast("int")).collect()
    classes = np.zeros(1 << TABLE_BITS, "u1")
    for at, k in reversed(hot):
        classes[at] = k
    marks = zlib.compress(classes.tobytes(), 1)
    index = rows.mapInArrow(_index(width, rule, marks), "t long, c long, n int, last long")
    lists = index.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.max("n").alias("most")).where("lo <> hi")
    # a list of short sets is compared in blocks from a quarter of that on, as their prefixes are light to carry
    lists = lists.select("t", "k", ((F.col("k") > crowd) | ((F.col("k") > crowd // 4) & (F.col("most") <= 512))).alias("crowded"))
    listed = cut(index.join(lists, "t").distinct())
    # short lists
    base = lambda n: F.expr(f"{n} - ({percent} * {n} + 99) div 100 + 1")
    short = listed.where(~F.col("crowded"))
    a, b = short.select("t", F.col("c").alias("a"), F.col("n").alias("n"), F.col("last").alias("la")), short.select("t", F.col("c").alias("b"), F.col("n").alias("m"), F.col("last").alias("lb"))
    both = a.join(b, "t").where((F.col("a") < F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    shared = both.groupBy("a", "b", "n", "m", "la", "lb").agg(F.count("*").alias("o"))
    rest = F.when(F.col("la") <= F.col("lb"), F.col("n") - base("n")).otherwise(F.col("m") - base("m"))
    need = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    pairs = shared.where(F.col("o") + rest >= need).select("a", "b")
    # families, and what else is in crowded lists
    many = listed.where("crowded").select("t", "c", "n", "k")
    stars = _families(rows, named, many, rule, width, block)
    many = many.join(components(stars).select(F.col("node").alias("c"), "component"), "c", "left").withColumn("family", F.coalesce("component", "c")).drop("component")
    apart = many.groupBy("t").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("t")
    many = cut(many.join(apart, "t", "left_semi"))
    some = many.groupBy("c").agg(F.collect_set("t").alias("ts"))
    prefixes = rows.mapInArrow(_prefixes(width, rule, marks), "c long, end long, prefix binary").groupBy("c").agg(F.first("end").alias("end"), F.first("prefix").alias("prefix")).join(some, "c")
    n_blocks = F.ceil(F.col("k") / block).cast("int")
    many = many.join(prefixes, "c").withColumn("side", F.pmod(F.xxhash64("c"), n_blocks).cast("int"))
    many = many.withColumn("o", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    many = many.select("t", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "c", "n", "family", "end", "prefix", "ts")
    crowded = many.groupBy("t", "i", "j").applyInPandas(_crowd(rule), "a long, b long")
    pairs = cut(pairs.union(crowded).distinct())
    # verification on whole sets
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    texts = _sets_of(rows, named, wanted, width)
    full = pairs.join(texts.withColumnRenamed("c", "a"), "a").join(texts.select(F.col("c").alias("b"), F.col("x").alias("y")), "b")
    return named, full.select("a", "b", "x", "y").mapInPandas(_verify(rule), "a long, b long").union(stars)


def join(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    named, linked = links(docs, percent, width)
    heads = named.where("n > 0 and doc_id is not null").groupBy("c", "c2", "n").agg(F.min("doc_id").alias("head"))
    heads = cut(heads)
    of = heads.groupBy("c").agg(F.min("head").alias("head"))
    edges = linked.join(of.select(F.col("c").alias("a"), F.col("head").alias("x")), "a").join(of.select(F.col("c").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # ids that stand in several rows tie their classes together
    own = named.where("n > 0 and doc_id is not null").join(heads, ["c", "c2", "n"]).select("doc_id", "head").where("doc_id <> head")
    twice = named.where("n > 0 and doc_id is not null").select("doc_id", "c").distinct().groupBy("doc_id").count().where("count > 1")
    edges = edges.union(own.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    found = components(edges)
    low = own.select("doc_id", "head").groupBy("doc_id").agg(F.min("head").alias("head"))
    out = named.select("doc_id", F.col("n").alias("n_shingles")).join(low, "doc_id", "left").withColumn("head", F.coalesce("head", "doc_id"))
    out = out.join(found.select(F.col("node").alias("head"), "component"), "head", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "head")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id is the smallest of its group; empty texts and null ids stay."""
    out = join(docs, percent, width).where("doc_id is not null")
    gone = out.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
