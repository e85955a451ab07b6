"""Substrings that recur anywhere, by distributed prefix doubling over content-chosen positions.

Every `length`-byte window belongs to an anchor (see windows), and the windows of one anchor that follow each other form
a run. Positions to be ranked stand on a lattice around the anchors, a quarter of a window apart, so that equal strings
have equal positions.

1. Positions. Spark counts the anchors' grams of 64 bytes and keeps the runs whose gram recurs. Runs that are equal as a
   whole are one to all that follows, and all windows of a run with copies recur. The bytes of each other run that
   still shares its gram are cut out once and stored.
2. First round. The names of two neighbouring cells (a quarter of a window each) make a position's pair. Spark sorts
   all pairs by range; the place in that order, equal pairs having one, is the rank of half a window. A pair that stands
   alone in the order is unique, and goes.
3. Second round. A position's rank and the rank one cell further on (h = 1 cell: both must have survived) make the pair;
   sorted and ranked again, they name three quarters of a window.
4. Past the threshold. Every window holds such a position (its core) within its first quarter; the core's rank and what
   the window has left and right of it, a quarter of its bytes together, name the window. Windows without a ranked core
   are unique. Names are compared anchor by anchor; anchors with over `crowd` different runs deal a row per window out
   instead, counted by Spark, so that none meets in one task.
5. Recurring windows join into spans per document, and leave its bytes.

Hot grams, runs and windows are joined with salted keys, and sorted pairs of one value are dealt over tasks by the run's
name. First names are hashes of 64 bits; ranks are exact.

Defined cases: null counts as empty; matches never cross texts; a row repeats another's text as any copy does; texts
below the length keep all; very long texts are taken in parts; an empty table gives no rows; columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed, matched, stored
from .spans import BYTES, blocks, hashes, mix, slices, sums
from .windows import merged, runs_of

GRAM = 64
#: Cells of the lattice in a window, and in the core whose rank the last round gives.
CELLS, CORE = 4, 3
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _positions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, _last, data, offsets in blocks(batch.column("text")):
                r = runs_of(BYTES[data], offsets, length, GRAM)
                row = pa.array(first + r.text)
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array(r.gram.view("i8")),
                    "run": pa.array(r.run.view("i8")),
                    "n": pa.array(r.count.astype("i4")),
                    "d": pa.array(r.reach.astype("i4")),
                    "_id": batch.column("_id").take(row),
                    "_th": batch.column("_th").take(row),
                    "at": pa.array(r.start - offsets[r.text]),
                })

    return run


RUN = "g long, run long, n int, d int, _id long, _th long, at long"


def _cut_out(length: int):
    """The bytes of each run asked for."""
    kinds = {"g": pa.int64(), "run": pa.int64(), "n": pa.int32(), "d": pa.int32(), "alone": pa.bool_(), "crowded": pa.bool_(), "at": pa.int64(), "bytes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 500):
            out: dict[str, list] = {k: [] for k in kinds}
            rows = []
            for row, (text, runs, *key) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("text", "runs", "_id", "_th")), strict=True)):
                if key == last:  # repeated rows follow each other
                    continue
                raw, last = text.encode(), key
                for x in runs:
                    x["bytes"] = raw[x["at"] : x["at"] + x["n"] - 1 + length]
                    for k in kinds:
                        out[k].append(x[k])
                    rows.append(row)
            cols = {k: pa.array(out[k], kind) for k, kind in kinds.items()}
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_pydict(cols | {k: batch.column(k).take(take) for k in ("_id", "_th")})

    return run


def _pairs(length: int):
    """For each position of a run's lattice with two whole cells: the names of both."""
    cell = length // CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            d = batch.column("d").to_numpy().astype("i8")
            for a, b, data, offsets in blocks(batch.column("bytes")):
                anchor, size = d[a:b], np.diff(offsets)
                low, high = -(anchor // cell), (size - anchor) // cell - 2  # first and last position, in cells from the anchor
                count = np.maximum(high - low + 1, 0)
                of = np.repeat(np.arange(b - a), count)
                m = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
                at = offsets[:-1][of] + anchor[of] + m * cell
                s = sums(BYTES[data])
                take = pa.array(a + of)
                yield pa.RecordBatch.from_pydict({
                    "run": batch.column("run").take(take),
                    "g": batch.column("g").take(take),
                    "crowded": batch.column("crowded").take(take),
                    "m": pa.array(m.astype("i4")),
                    "x": pa.array(hashes(s, at, at + cell).view("i8")),
                    "y": pa.array(hashes(s, at + cell, at + 2 * cell).view("i8")),
                })

    return run


POSITION = "run long, g long, crowded boolean, m int"


def _begins(batch: pa.RecordBatch, last: tuple[int, int] | None) -> np.ndarray:
    """Which rows of a sorted batch begin a new pair, given the pair before them."""
    x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    new[0] = last != (x[0], y[0])
    return new


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's number, first and last pair, and count of pairs."""
    first, last, pairs = None, None, 0
    for batch in slices(batches, 10_000):
        if batch.num_rows:
            pairs += int(_begins(batch, last).sum())
            at = lambda k: (batch.column("x")[k].as_py(), batch.column("y")[k].as_py())  # noqa: B023, E731
            first, last = first or at(0), at(batch.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "x0": [first[0]], "y0": [first[1]], "x1": [last[0]], "y1": [last[1]], "pairs": [pairs]})


def _number(before: dict[int, tuple[int, bool, bool]]):
    """Ranks of a sorted partition's rows; those of pairs that stand alone are left out.

    `before`: for a partition, its first rank, and whether its first and last pair go on beyond it. Batches stream: of
    those before, the last row alone waits for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, joins_left, joins_right = before.get(TaskContext.get().partitionId(), (0, False, False))
        rank -= 1
        wait, wait_new, last = None, False, None

        def out(rows: pa.RecordBatch, ranks: np.ndarray, new: np.ndarray, more: bool) -> pa.RecordBatch:
            """`more`: whether the pair of the last row goes on."""
            alone = new & np.append(new[1:], not more)
            return rows.append_column("rank", pa.array(ranks)).filter(pa.array(~alone)).select(["run", "g", "crowded", "m", "rank"])

        for batch in slices(batches, 10_000):
            if not batch.num_rows:
                continue
            new = _begins(batch, last)
            begins = new.copy()
            if last is None and joins_left:
                begins[0] = False  # not alone, but the first of its rank here
            if wait is not None:
                yield out(wait, np.array([rank]), np.array([wait_new]), not new[0])
            ranks = rank + np.cumsum(new)
            n = batch.num_rows - 1
            if n:
                yield out(batch.slice(0, n), ranks[:n], begins[:n], not new[n])
            wait, wait_new, rank = batch.slice(n), bool(begins[n]), int(ranks[n])
            last = (batch.column("x")[n].as_py(), batch.column("y")[n].as_py())
        if wait is not None:
            yield out(wait, np.array([rank]), np.array([wait_new]), joins_right)

    return run


def ranked(pairs: DataFrame) -> DataFrame:
    """One round: `pairs` (a position and its pair x, y) sorted by Spark, and ranked by place. Unique pairs go.

    Rows of one pair go on to the next partition where they are many. What the driver gets is a row per partition.
    """
    order = ["x", "y", "run", "m"]
    rows = cut(pairs.repartitionByRange(*order).sortWithinPartitions(*order))
    ends = sorted(rows.select("x", "y").mapInArrow(_ends, "part int, x0 long, y0 long, x1 long, y1 long, pairs long").collect())
    before, base, last = {}, 0, None
    for k, e in enumerate(ends):
        left = last == (e.x0, e.y0)
        last = (e.x1, e.y1)
        right = k + 1 < len(ends) and last == (ends[k + 1].x0, ends[k + 1].y0)
        base -= left
        before[e.part] = (base, left, right)
        base += e.pairs
    return rows.mapInArrow(_number(before), POSITION + ", rank long")


def window_names(n: np.ndarray, d: np.ndarray, contents: list[bytes], cores: tuple[np.ndarray, np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of the given runs that have a ranked core: the run's number, the window's number, and its name.

    `cores`: run's number, place in cells from the anchor, and rank.
    """
    cell = length // CELLS
    data = np.frombuffer(b"".join(contents), "u1")
    base = np.concatenate([[0], np.cumsum([len(x) for x in contents])])[:-1].astype("i8")
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    m = -((d[of] - k) // cell)  # the first lattice position at or after the window's start
    key = cores[0] * 256 + cores[1] + 128
    order = np.argsort(key)
    key, rank = key[order], cores[2][order]
    want = of * 256 + m + 128
    at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
    has = key[at] == want if len(key) else np.zeros(len(want), bool)
    of, k, m, at = of[has], k[has], m[has], at[has]
    left = m * cell - (k - d[of])
    start = base[of] + k
    s = sums(BYTES[data])
    core = start + left
    before, after = hashes(s, start, core), hashes(s, core + CORE * cell, start + length)
    name = mix(mix(rank[at].astype("u8") + left.astype("u8") * _ODD) ^ mix(before + _U(1)) * _U(3) ^ after)
    return of, k, name


def _compare(length: int):
    spans = {"_id": "i8", "_th": "i8", "start": "i8", "end": "i8"}

    def run(runs: pd.DataFrame, cores: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({k: pd.Series([], dtype=v) for k, v in spans.items()})
        if not len(runs) or not len(cores):
            return none
        # repeated rows may bring a run again, which then has copies
        runs = runs.drop_duplicates("run").sort_values("run", ignore_index=True)
        number = np.searchsorted(runs["run"].to_numpy(), cores["run"].to_numpy())
        n, d = runs["n"].to_numpy("i8"), runs["d"].to_numpy("i8")
        of, k, name = window_names(n, d, runs["bytes"].tolist(), (number, cores["m"].to_numpy("i8"), cores["rank"].to_numpy("i8")), length)
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        hit = np.zeros(len(name), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        hit &= runs["alone"].to_numpy(bool)[of]  # all windows of the other runs are known to recur
        if not hit.any():
            return none
        of, k = of[hit], k[hit]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (k[1:] != k[:-1] + 1)
        a, b = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:] - 1, [len(of) - 1]])
        at = runs["at"].to_numpy("i8")
        return pd.DataFrame({"_id": runs["_id"].to_numpy()[of[a]], "_th": runs["_th"].to_numpy()[of[a]], "start": at[of[a]] + k[a], "end": at[of[b]] + k[b] + length})

    return run


def _as_rows(length: int):
    """A row per window with a ranked core."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                x = batch.iloc[low : low + 500]
                cores = [(i, c["m"], c["rank"]) for i, many in enumerate(x["cores"]) for c in many]
                of, k, name = window_names(x["n"].to_numpy("i8"), x["d"].to_numpy("i8"), x["bytes"].tolist(), tuple(np.array(v, "i8") for v in zip(*cores, strict=True)), length)
                yield pd.DataFrame({"_id": x["_id"].to_numpy()[of], "_th": x["_th"].to_numpy()[of], "alone": x["alone"].to_numpy()[of], "start": x["at"].to_numpy()[of] + k, "name": name.view("i8")})

    return run


def recurring_spans(rows: DataFrame, length: int = 400, crowd: int = 4096, bucket: int = 1500) -> DataFrame:
    """Per key of `rows` (keyed texts): `spans`, the array of (start, end) in bytes that recurring windows cover."""
    if length < CELLS * GRAM // 2:
        raise ValueError(f"windows have {CELLS * GRAM // 2} bytes or more")
    text = rows.select("_id", "_th", "text")
    every = stored(text.mapInArrow(_positions(length), RUN))
    grams = cut(every.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"))
    found = stored(matched(every, grams, "g").drop("c"))
    folded = found.groupBy("run").agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_th", "at", "g", "n", "d")).alias("first"))
    folded = cut(folded.select("run", "copies", "first.*"))
    whole = matched(found, folded.where("copies > 1").select("run", F.col("copies").alias("c")), "run")
    whole = whole.select("_id", "_th", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))
    # only anchors where a run of one copy may meet another run
    open_ = cut(folded.groupBy("g").agg(F.count("*").alias("c"), F.min("copies").alias("least")).where("c > 1 and least = 1").select("g", "c"))
    asked = matched(folded, open_, "g").withColumn("alone", F.col("copies") == 1).withColumn("crowded", F.col("c") > crowd)
    asked = asked.groupBy("_id", "_th").agg(F.collect_list(F.struct("g", "run", "n", "d", "alone", "crowded", "at")).alias("runs"))
    runs = "g long, run long, n int, d int, alone boolean, crowded boolean, at long, bytes binary, _id long, _th long"
    runs = stored(text.join(asked, ["_id", "_th"]).mapInArrow(_cut_out(length), runs))
    # the rounds
    half = ranked(runs.select("run", "g", "crowded", "d", "bytes").mapInArrow(_pairs(length), POSITION + ", x long, y long"))
    ahead = Window.partitionBy("run").orderBy("m")
    pairs = half.withColumn("next", F.lead("m").over(ahead)).withColumn("y", F.lead("rank").over(ahead)).where("next = m + 1")
    cores = cut(ranked(pairs.select("run", "g", "crowded", "m", F.col("rank").alias("x"), "y")))
    # past the threshold
    few = runs.where("not crowded")
    n_buckets = max(1, few.count() // bucket)
    dealt = F.pmod(F.xxhash64("g"), F.lit(n_buckets)).alias("bucket")
    some = few.select("run", "n", "d", "alone", "at", "bytes", "_id", "_th", dealt).groupBy("bucket").cogroup(cores.where("not crowded").select("run", "m", "rank", dealt).groupBy("bucket"))
    some = some.applyInPandas(_compare(length), "_id long, _th long, start long, end long")
    of_run = cores.where("crowded").groupBy("run").agg(F.collect_list(F.struct("m", "rank")).alias("cores"))
    many = runs.where("crowded").join(of_run, "run").mapInPandas(_as_rows(length), "_id long, _th long, alone boolean, start long, name long")
    twice = cut(many.groupBy("name").agg(F.count("*").alias("c")).where("c > 1"))
    more = matched(many.where("alone"), twice, "name").select("_id", "_th", "start", (F.col("start") + length).alias("end"))
    return whole.union(some).union(more).groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw = text.encode()
            if spans is None or not len(spans):
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            start, end = merged(np.array([x["start"] for x in spans], "i8"), np.array([x["end"] for x in spans], "i8"))
            h, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                h.update(raw[at:a])
                at = b
            h.update(raw[at:])
            out.append((len(raw), int((end - start).sum()), len(start), h.hexdigest()))
        n, removed, spans, digest = zip(*out, strict=True) if out else ((), (), (), ())
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": digest})


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs)
    out = rows.join(recurring_spans(rows, length), ["_id", "_th"], "left")
    return out.select("doc_id", "text", "spans").mapInPandas(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
