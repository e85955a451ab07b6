"""Line deduplication by pairwise alignment.

1. Every text becomes the sequence of its lines' hashes. A window is a run of lines that just suffices for a block:
   `min_lines` lines, or fewer of `min_bytes` bytes. A window that several documents hold names its first holder (the
   smallest id). A document overlaps the first holders of its rare shared windows, those of at most `rare` documents.
2. Each such pair is aligned with patience diff on the two hash sequences: common ends, then lines unique on both sides
   in their longest increasing order, then the gaps between them. Runs of aligned lines are common blocks; blocks of at
   least `min_lines` lines or `min_bytes` bytes are deleted from the later document. Where the alignment leaves lines that
   the partner holds (a second copy, a moved block, a gap without unique lines), the longest runs of the later document's
   lines that stand anywhere in the partner are found by a suffix automaton and judged as blocks too.
3. Windows shared by more documents than that, where blocks have not covered all their lines yet, ask their first
   holders in the same way, so that large groups of copies lose nothing to the bound.

Hot windows and first holders that very many documents ask are joined with salted keys. Every line of a block stands in a window inside the block, so that asking the windows' first holders is enough. A
document has at most one partner per window, whatever the size of a group of copies, and the first holder of a line
never loses it. Blocks are judged on the input.

Defined cases: null and empty texts have no lines and stay empty; lines end at \\n and compare by bytes; blank lines
align but don't count towards a block; rows that repeat both id and text are one document, of which none is later;
with one id and several texts, the text's hash decides which is later; a null id is later than every other; an empty
table gives no rows; columns besides doc_id and text are ignored (dedup_text keeps them).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, keyed, matched
from .spans import BYTES, NOT_SPACE, blocks, hashes, slices, sums


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each text's lines, and their bytes without white space at hand: 0 for blank ones."""
    for batch in slices(batches):
        for a, b, data, offsets in blocks(batch.column("text")):
            breaks = np.flatnonzero(data == 10)
            full = np.flatnonzero(np.diff(offsets) > 0)
            # every newline ends a line, and so does the end of a text that has bytes
            ends = np.concatenate([breaks, offsets[1:][full]])
            text = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, full])
            order = np.lexsort((ends, text))
            ends, text = ends[order], text[order]
            first = np.searchsorted(text, np.arange(len(offsets)))
            starts = np.empty(len(ends), "i8")
            starts[1:] = ends[:-1] + 1
            begin = first[:-1][np.diff(first) > 0]
            starts[begin] = offsets[:-1][text[begin]]
            h = hashes(sums(BYTES[data]), starts, ends).view("i8")
            solid = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
            size = np.where(solid[ends] > solid[starts], ends - starts, 0)
            at = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id").slice(a, b - a),
                "_th": batch.column("_th").slice(a, b - a),
                "hs": pa.ListArray.from_arrays(at, pa.array(h)),
                "sizes": pa.ListArray.from_arrays(at, pa.array(size, pa.int32())),
            })


def _windows(min_lines: int, min_bytes: int):
    """Each text's windows: first and last position, joint hash, and whether it's the first of its hash in the text.

    A window begins and ends with a line that isn't blank; blank lines between count for the hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hs, sizes = batch.column("hs"), batch.column("sizes").flatten().to_numpy()
            n = hs.value_lengths().to_numpy()
            begin = np.cumsum(n) - n
            s = sums(hs.flatten().to_numpy().view("u8"))
            solid = np.flatnonzero(sizes > 0)
            text = np.repeat(np.arange(len(n)), n)[solid]
            size = np.concatenate([[0], np.cumsum(sizes[solid], dtype="i8")])
            found = []
            for k in range(1, min_lines + 1):
                i = np.arange(len(solid) - k + 1)
                j = i + k - 1
                i = i[(text[i] == text[j]) & ((k == min_lines) | (size[j + 1] - size[i] >= min_bytes))]
                found.append((text[i], solid[i], solid[i + k - 1]))
            text, at, to = (np.concatenate(x) for x in zip(*found, strict=True))
            h = hashes(s, at, to + 1).view("i8")
            order = np.lexsort((at, h, text))
            new = np.ones(len(order), bool)
            new[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id").take(pa.array(text)),
                "_th": batch.column("_th").take(pa.array(text)),
                "at": pa.array(at - begin[text], pa.int32()),
                "to": pa.array(to - begin[text], pa.int32()),
                "h": pa.array(h),
                "new": pa.array(new),
            })

    return run


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {h: y for y, h in enumerate(b[j:j_end], j) if in_b[h] == 1}
        pairs = [(x, where[h]) for x, h in enumerate(a[i:i_end], i) if in_a[h] == 1 and h in where]
        if not pairs:
            continue
        tails: list[int] = []  # longest increasing run of positions in b
        heads: list[int] = []
        before = [-1] * len(pairs)
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            before[k] = heads[at - 1] if at else -1
            tails[at : at + 1] = [y]
            heads[at : at + 1] = [k]
        chain, k = [], heads[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        for x, y in reversed(chain):
            todo.append((i, x, j, y))
            i, j = x, y  # the anchor itself opens the next gap and is matched there as a common start
        todo.append((i, i_end, j, j_end))
    return sorted(out)


def held_runs(a: list[int], b: list[int]) -> list[int]:
    """For each position of `a`, the length of the longest run ending there that stands anywhere in `b`.

    A suffix automaton of `b` reads `a`, so that repeated lines don't cost the product of the lengths."""
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for h in b:
        new, p = len(to), last
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and h not in to[p]:
            to[p][h] = new
            p = link[p]
        if p >= 0:
            q = to[p][h]
            if size[q] > size[p] + 1:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and to[p].get(h) == q:
                    to[p][h] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    out, at, n = [], 0, 0
    for h in a:
        while at and h not in to[at]:
            at = link[at]
            n = size[at]
        if h in to[at]:
            at, n = to[at][h], n + 1
        out.append(n)
    return out


def common_blocks(a: list[int], b: list[int], sizes: list[int], min_lines: int, min_bytes: int) -> list[int]:
    """Positions of `a`, the later one, that stand in common blocks of enough lines or bytes."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for x, y in [*patience(a, b), (-1, -1)]:
        if (x, y) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] > 0 for k in block) >= min_lines or sum(sizes[k] for k in block) >= min_bytes:
                out += block
            block = []
        block.append(x)
        last = (x, y)
    gone, there = set(out), set(b)
    if any(sizes[k] > 0 and k not in gone and h in there for k, h in enumerate(a)):
        solid, total, cover = [0], [0], [0] * (len(a) + 1)
        for z in sizes:
            solid.append(solid[-1] + (z > 0))
            total.append(total[-1] + z)
        for k, n in enumerate(held_runs(a, b), 1):
            if n and (solid[k] - solid[k - n] >= min_lines or total[k] - total[k - n] >= min_bytes):
                cover[k - n] += 1
                cover[k] -= 1
        gone |= {k for k, c in enumerate(accumulate(cover)) if c}
    return sorted(gone)


def _align(min_lines: int, min_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [common_blocks(a.tolist(), b.tolist(), s.tolist(), min_lines, min_bytes) for a, b, s in zip(batch["a"], batch["b"], batch["sizes"], strict=True)]
            yield pd.DataFrame({"_id": batch["_id"], "_th": batch["_th"], "gone": gone})

    return run


def duplicated(docs: DataFrame, rare: int = 50, min_lines: int = 3, min_bytes: int = 80) -> DataFrame:
    """For each document that loses lines: its key _id, _th and the positions `gone`."""
    rows = keyed(docs).select("_id", "_th", "text")
    seq = cut(rows.mapInArrow(_sequences, "_id long, _th long, hs array<long>, sizes array<int>").dropDuplicates(["_id", "_th"]))
    window = seq.select("_id", "_th", "hs", "sizes").mapInArrow(_windows(min_lines, min_bytes), "_id long, _th long, at int, to int, h long, new boolean")
    held = window.where("new").select("h", "_id", "_th")
    shared = held.groupBy("h").agg(F.min(F.struct("_id", "_th")).alias("first"), F.count("*").alias("df")).where("df > 1")
    shared = cut(shared.select("h", F.col("first._id").alias("f_id"), F.col("first._th").alias("f_th"), F.col("df").alias("c")))

    def aligned(asking: DataFrame) -> DataFrame:
        pairs = cut(asking.where("_id <> f_id or _th <> f_th").select("_id", "_th", F.xxhash64("f_id", "f_th").alias("f")).distinct())
        holders = pairs.groupBy("f").agg(F.count("*").alias("c"))
        holders = cut(seq.select(F.xxhash64("_id", "_th").alias("f"), F.col("hs").alias("b")).join(holders, "f"))
        both = matched(pairs, holders, "f").join(seq.select("_id", "_th", F.col("hs").alias("a"), "sizes"), ["_id", "_th"])
        return both.select("_id", "_th", "a", "b", "sizes").mapInPandas(_align(min_lines, min_bytes), "_id long, _th long, gone array<int>").where("size(gone) > 0")

    by_rare = cut(aligned(matched(held, shared, "h").where(F.col("c") <= rare)))
    # a window asks if any of its lines is left; a line stands in at most `min_lines` windows for each size
    covered = by_rare.select("_id", "_th", F.explode("gone").alias("at")).distinct()
    left = matched(window, shared, "h").where(F.col("c") > rare).select("_id", "_th", "f_id", "f_th", F.explode(F.sequence("at", "to")).alias("at"))
    left = left.join(covered, ["_id", "_th", "at"], "left_anti")
    positions = by_rare.union(aligned(left)).select("_id", "_th", F.explode("gone").alias("at"))
    return positions.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def _without(text: str, gone) -> tuple[str, int]:
    lines = text.split("\n") if text else []
    drop = set(gone.tolist()) if gone is not None else set()
    return ("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text), len(lines)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept = [_without(t, g) for t, g in zip(batch["text"], batch["gone"], strict=True)]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"),
            "n_lines": [n for _, n in kept],
            "n_removed": [0 if g is None else len(g) for g in batch["gone"]],
            "kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t, _ in kept],
        })


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [t if g is None or t is None else _without(t, np.array(g))[0] for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "kept"])


def dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 (of the lines left, joined by newlines)."""
    rows = keyed(docs).join(duplicated(docs, **limits), ["_id", "_th"], "left")
    return rows.select("doc_id", "text", "gone").mapInPandas(_digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows and columns of `docs`, texts without the deleted lines, and n_chars (if there) to match."""
    gone = duplicated(docs, **limits)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    both = rows.join(gone, ["_id", "_th"], "left").select("row", "text", "gone")
    out = both.mapInArrow(_rewrite, rows.select("row").schema.add("kept", "string"))
    cols = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        same = F.col("kept").eqNullSafe(F.col("row.text"))
        cols["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(k) for k, v in cols.items()])
