"""Word windows that an earlier document holds, by compressed FM-indexes.

1. Every window of `length` words belongs to an anchor gram of ten words (see windows); a text falls into runs of
   windows with one anchor. Spark keeps the runs whose gram recurs, and folds runs of equal words into one with the
   smallest doc_id that holds it: every other document loses all windows of such a run, by name.
2. What different runs of one gram share is left. Runs are dealt into shards by their gram, so that windows which may
   be equal meet in one shard. A shard indexes its runs: the Burrows-Wheeler transform of their words in a wavelet matrix
   of packed bits with running counts; the suffix order itself is dropped. Two trees of minima over that order hold the
   lengths that neighbouring suffixes share (a byte each), and their documents.
3. Every run streams through the index from its last word backwards, against the documents that come before its own. A
   step narrows the interval by one word. Where no earlier document is left in it, the match is cut back to the length
   that a neighbouring suffix shares, which widens the interval, until the step succeeds. This gives the matching
   statistic at each word: how many words from there on an earlier document holds. Stretches of at least `length` are
   reported.
4. A gram with more than `crowd` different runs deals its windows out as rows and takes the smallest doc_id per window
   by a grouped minimum, so that no shard grows with such a gram.

Hot grams, runs and windows are joined with salted keys.

Defined cases: null texts have no words; a null doc_id counts as later than every other; rows that share a doc_id are
one document and never earlier than each other; texts shorter than a window keep all; very long texts are taken in parts;
an empty table gives no rows; columns besides doc_id and text are ignored (dedup_text keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, keyed, matched, stored
from .spans import blocks, hashes, mix, slices, sums
from .windows import merged, runs_of, word_hashes

GRAM = 10
_U = np.uint64


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, _last, data, offsets in blocks(batch.column("text")):
                words, first = word_hashes(data, offsets)
                r = runs_of(words, first, length, GRAM)
                take = pa.array(row + r.text)
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array(r.gram.view("i8")),
                    "run": pa.array(r.run.view("i8")),
                    "n": pa.array(r.count.astype("i4")),
                    "d": pa.array(r.reach.astype("i4")),
                    "_id": batch.column("_id").take(take),
                    "_th": batch.column("_th").take(take),
                    "at": pa.array(r.start - first[r.text]),
                })

    return run


RUN = "g long, run long, n int, d int, _id long, _th long, at long"


def _cut_out(length: int):
    """The words of each run asked for, joined by spaces."""
    kinds = {"g": pa.int64(), "run": pa.int64(), "n": pa.int32(), "d": pa.int32(), "crowded": pa.bool_(), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 500):
            out: dict[str, list] = {k: [] for k in kinds}
            rows = []
            for row, (text, asked, *key) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("text", "runs", "_id", "_th")), strict=True)):
                if key == last:  # repeated rows follow each other
                    continue
                words, last = text.encode().split(), key
                for x in asked:
                    x["words"] = b" ".join(words[x["at"] : x["at"] + x["n"] - 1 + length])
                    for k in kinds:
                        out[k].append(x[k])
                    rows.append(row)
            first = batch.column("_id").take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], kind) for k, kind in kinds.items()} | {"first": first})

    return run


class Minima:
    """A complete binary tree of minima over an array: twice its size, and log time for every question."""

    def __init__(self, values: np.ndarray, beyond: int):
        self.leaves = 1 << max(1, (len(values) - 1).bit_length())
        self.tree = np.full(2 * self.leaves, beyond, values.dtype)
        self.tree[self.leaves : self.leaves + len(values)] = values
        size = self.leaves
        while size > 1:
            self.tree[size // 2 : size] = np.minimum(self.tree[size : 2 * size : 2], self.tree[size + 1 : 2 * size : 2])
            size //= 2
        self.beyond = beyond

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest value in each [low, high); short ones are looked through, long ones climb the tree."""
        out = np.full(len(low), self.beyond, self.tree.dtype)
        short = high - low <= 4
        for k in range(4):
            on = np.flatnonzero(short & (low + k < high))
            out[on] = np.minimum(out[on], self.tree[self.leaves + low[on] + k])
        on = np.flatnonzero(~short)
        a, b = low[on] + self.leaves, high[on] + self.leaves
        while len(on):
            odd = a & 1 == 1
            out[on[odd]] = np.minimum(out[on[odd]], self.tree[a[odd]])
            odd = b & 1 == 1
            out[on[odd]] = np.minimum(out[on[odd]], self.tree[b[odd] - 1])
            a, b = (a + 1) >> 1, b >> 1
            more = a < b
            on, a, b = on[more], a[more], b[more]
        return out

    def _search(self, at: np.ndarray, bar: np.ndarray, step: int) -> np.ndarray:
        """The nearest place from `at` on, leftwards (-1) or rightwards (1), with a value below `bar`; there must be one."""
        out = at.copy()
        on = np.arange(len(at))
        for _ in range(3):  # it is near as a rule
            on = on[self.tree[self.leaves + out[on]] >= bar[on]]
            if not len(on):
                return out
            out[on] += step
        node, bar = out[on] + self.leaves, bar[on]
        while (go := np.flatnonzero(self.tree[node] >= bar)).size:
            up = node[go] + (step > 0)
            node[go] = (up >> np.bitwise_count((up & -up) - 1)) - (step < 0)
        while (go := np.flatnonzero(node < self.leaves)).size:
            child = 2 * node[go] + (step < 0)
            node[go] = child + step * (self.tree[child] >= bar[go])
        out[on] = node - self.leaves
        return out

    def before(self, at: np.ndarray, bar: np.ndarray) -> np.ndarray:
        return self._search(at, bar, -1)

    def after(self, at: np.ndarray, bar: np.ndarray) -> np.ndarray:
        return self._search(at, bar, 1)


class FMIndex:
    """Backward search over texts of symbols 1, 2, ..., each text ended by 0, for patterns of up to `length` symbols.

    `stop` is the end of each symbol's text (the place of its 0), and `owner` numbers the document that it belongs to.
    """

    def __init__(self, text: np.ndarray, stop: np.ndarray, owner: np.ndarray, length: int):
        n = len(text)
        rank, h = text.astype("i8"), 1
        while h < length + 1:  # order of suffixes by their first `length` symbols at least, which is all that is asked
            ahead = np.zeros(n, "i8")
            ahead[: n - h] = rank[h:] + 1 if h < n else 0
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            if rank.max(initial=0) == n - 1:
                break
            h *= 2
        order = np.argsort(rank, kind="stable")
        self.owners = Minima(owner[order].astype("i4"), np.iinfo("i4").max)
        self.shared = Minima(np.append(self._shared(text, stop, order, length), [0]).astype("u1"), 0)
        bwt = text[order - 1]
        self.size, self.length = n, length
        self.symbols = int(text.max(initial=0)) + 1
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(bool)
            words = np.zeros(n // 64 + 1, _U)
            packed = np.packbits(bit, bitorder="little")
            words.view("u1")[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="i4")]).astype("i4")
            zeros = n - int(before[-1])
            self.levels.append((words, before, zeros))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.start = self._down(np.arange(self.symbols), np.zeros(self.symbols, "i8"))

    @staticmethod
    def _shared(text: np.ndarray, stop: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
        """How many symbols each suffix shares with the one before it in the order, up to `length`; by halves of hashes."""
        s = sums(mix(text.astype("u8") + _U(1)))
        a, b = order[:-1], order[1:]
        most = np.minimum(np.minimum(stop[a] - a, stop[b] - b), length)
        low, high = np.zeros(len(a), "i8"), most
        while (on := low < high).any():
            mid = (low + high + 1) // 2
            same = hashes(s, a, a + mid) == hashes(s, b, b + mid)
            low, high = np.where(on & same, mid, low), np.where(on & ~same, mid - 1, high)
        return np.concatenate([[0], low])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the transform leads among all places of `symbol` on the wavelet matrix's last level."""
        top = len(self.levels) - 1
        for k, (words, before, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((_U(1) << (at & 63).astype("u8")) - _U(1)))
            at = np.where((symbol >> (top - k)) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.concatenate([self.start[symbol]] * 2)
        both += np.concatenate([self.count[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]


    def widened(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns' first n symbols (all suffixes where n is 0)."""
        some = n > 0
        a, b = np.zeros_like(low), np.full_like(high, self.size)
        a[some], b[some] = self.shared.before(low[some], n[some]), self.shared.after(high[some], n[some])
        return a, b

    def statistics(self, pattern: list[np.ndarray], own: np.ndarray) -> list[np.ndarray]:
        """For each pattern and each of its symbols: how many symbols from there on, up to `length`, stand in a text of
        an owner below the pattern's own."""
        size = np.array([len(x) for x in pattern], "i8")
        at = np.cumsum(size) - size
        flat = np.concatenate(pattern)
        out = np.zeros(len(flat), "i4")
        order = np.argsort(-size, kind="stable")
        low, high, n = np.zeros(len(size), "i8"), np.full(len(size), self.size), np.zeros(len(size), "i8")
        for back in range(int(size.max(initial=0))):
            live = order[: int(np.searchsorted(-size[order], -back, "left"))]
            symbol = flat[at[live] + size[live] - 1 - back]
            todo = np.arange(len(live))
            while len(todo):
                x = live[todo]
                a, b = self.step(symbol[todo], low[x], high[x])
                good = self.owners.least(a, b) < own[x]
                y = x[good]
                low[y], high[y], n[y] = a[good], b[good], n[y] + 1
                todo, x = todo[~good], x[~good]
                more = n[x] > 0  # what matched nothing stays at nothing
                todo, x = todo[more], x[more]
                n[x] = np.maximum(self.shared.tree[self.shared.leaves + low[x]], self.shared.tree[self.shared.leaves + high[x]])
                low[x], high[x] = self.widened(low[x], high[x], n[x])
            over = live[n[live] > self.length]
            n[over] = self.length
            low[over], high[over] = self.widened(low[over], high[over], n[over])
            out[at[live] + size[live] - 1 - back] = n[live]
        return np.split(out, at[1:])


def earlier(texts: list[np.ndarray], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text and each of its windows of `length` symbols, whether a text of a smaller owner holds the window."""
    size = np.array([len(t) for t in texts])
    _, symbols = np.unique(np.concatenate(texts), return_inverse=True)
    text = np.zeros(len(symbols) + len(texts), "i8")
    at = np.concatenate([[0], np.cumsum(size + 1)])
    of = np.repeat(np.arange(len(texts)), size + 1)
    inside = np.ones(len(text), bool)
    inside[at[1:] - 1] = False
    text[inside] = symbols + 1
    own = np.unique(owner, return_inverse=True)[1]
    index = FMIndex(text, at[1:][of] - 1, own[of], length)
    found = index.statistics(np.split(symbols + 1, np.cumsum(size)[:-1]), own)
    return [x[: max(0, len(x) - length + 1)] >= length for x in found]


def _shard(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        data = b"\n".join(group["words"])
        sizes = np.array([len(w) for w in group["words"]])
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        offsets[-1] -= 1
        words, first = word_hashes(np.frombuffer(data, "u1"), offsets)
        texts = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        own = group["first"].to_numpy("i8")
        rows = []
        for i, there in enumerate(earlier(texts, own, length)):
            hit = np.concatenate([[0], there.astype("i1"), [0]])
            edge = np.flatnonzero(np.diff(hit))
            rows += [(i, a, b) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        i, a, b = (np.array(v, "i8") for v in zip(*rows, strict=True)) if rows else [np.zeros(0, "i8")] * 3
        return pd.DataFrame({"run": group["run"].to_numpy()[i], "lo": a, "hi": b - 1 + length})

    return run


def _as_rows(length: int):
    """A row per window of a run, named by its words and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 2000):
                x = batch.iloc[low : low + 2000]
                sizes = np.array([len(w) for w in x["words"]])
                offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
                offsets[-1] -= 1
                words, first = word_hashes(np.frombuffer(b"\n".join(x["words"]), "u1"), offsets)
                n = x["n"].to_numpy("i8")
                of = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                h = hashes(sums(words), first[of] + k, first[of] + k + length)
                name = mix(h ^ x["g"].to_numpy().view("u8")[of] ^ ((x["d"].to_numpy("i8")[of] - k).astype("u8") * _U(0x9E3779B97F4A7C15)))
                yield pd.DataFrame({c: x[c].to_numpy()[of] for c in ("run", "first")} | {"lo": k, "name": name.view("i8")})

    return run


def earlier_spans(rows: DataFrame, length: int = 50, crowd: int = 1024, shard: int = 2500) -> DataFrame:
    """Per key of `rows` (keyed texts): `spans`, the array of (start, end) in words that an earlier document's windows cover."""
    text = rows.select("_id", "_th", "text")
    every = stored(text.mapInArrow(_runs(length), RUN))
    grams = cut(every.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"))
    found = stored(matched(every, grams, "g").drop("c"))
    folded = found.groupBy("run").agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_th", "at", "g", "n", "d")).alias("first"))
    folded = cut(folded.select("run", "copies", "first.*"))
    open_ = cut(folded.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"))
    asked = matched(folded, open_, "g").withColumn("crowded", F.col("c") > crowd)
    asked = asked.groupBy("_id", "_th").agg(F.collect_list(F.struct("g", "run", "n", "d", "crowded", "at")).alias("runs"))
    runs = "g long, run long, n int, d int, crowded boolean, words binary, first long"
    runs = stored(text.join(asked, ["_id", "_th"]).mapInArrow(_cut_out(length), runs))
    few = runs.where("not crowded")
    n_shards = max(1, few.count() // shard)
    lost = few.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(n_shards))).groupBy("shard").applyInPandas(_shard(length), "run long, lo long, hi long")
    many = runs.where("crowded").mapInPandas(_as_rows(length), "run long, first long, lo long, name long")
    low = cut(many.groupBy("name").agg(F.count("*").alias("c"), F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("name", "c", "low"))
    lost = lost.union(matched(many, low, "name").where("low < first").select("run", "lo", (F.col("lo") + length).alias("hi")))
    # a run's first holder loses what an earlier document holds; later holders lose all windows of the run
    lost = lost.groupBy("run").agg(F.collect_set(F.struct("lo", "hi")).alias("lost"))
    judged = cut(folded.select("run", F.col("copies").alias("c"), F.col("_id").alias("first")).join(lost, "run", "left").where("c > 1 or lost is not null"))
    every = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n") - 1 + length).cast("long").alias("hi")))
    spans = matched(found, judged, "run").select("_id", "_th", "at", F.explode(F.when(F.col("_id") > F.col("first"), every).otherwise(F.col("lost"))).alias("x"))
    spans = spans.select("_id", "_th", F.struct((F.col("at") + F.col("x.lo")).alias("start"), (F.col("at") + F.col("x.hi")).alias("end")).alias("x"))
    return spans.groupBy("_id", "_th").agg(F.collect_set("x").alias("spans"))


def _keep(text: str, spans) -> tuple[list[bytes], int]:
    words = text.encode().split()
    if spans is None or not len(spans):
        return words, len(words)
    start, end = merged(np.array([x["start"] for x in spans], "i8"), np.array([x["end"] for x in spans], "i8"))
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept += words[at:a]
        at = b
    return kept + words[at:], len(words)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            kept, n = _keep(text, spans)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, digest = zip(*out, strict=True) if out else ((), (), ())
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": n, "n_removed": removed, "kept_sha256": digest})


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space)."""
    rows = keyed(docs)
    out = rows.join(earlier_spans(rows, length), ["_id", "_th"], "left")
    return out.select("doc_id", "text", "spans").mapInPandas(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [t if s is None else b" ".join(_keep(t, s)[0]).decode() if t is not None else None for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "kept"])


def dedup_text(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows and columns of `docs`; a text that loses words becomes the words left, joined by one space."""
    spans = earlier_spans(keyed(docs), length)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    both = rows.join(spans, ["_id", "_th"], "left").select("row", "text", "spans")
    out = both.mapInArrow(_rewrite, rows.select("row").schema.add("kept", "string"))
    cols = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        same = F.col("kept").eqNullSafe(F.col("row.text"))
        cols["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(k) for k, v in cols.items()])
