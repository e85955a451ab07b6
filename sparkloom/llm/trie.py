"""The trie of conversations by their turns: shared prefixes, who ends where, and what sharing saves.

1. Order and fingerprints. Turns are sorted by conversation and place over all machines; a conversation may lie in
   several partitions. Numpy scans each partition: a turn's hash enters a polynomial at its place, and running sums give the
   fingerprint of every prefix. What a partition hands to the next one is a count and two numbers of its last conversation,
   one row per partition on the driver.
2. Groups and verification. Turns of one depth and fingerprint are candidates for one node. Each is compared, role and
   text, with the turn of the group's smallest conversation. Where all turns of two prefixes agree with the same
   representatives, the prefixes are equal, as a prefix's fingerprint and its last turn give the fingerprint before. A turn
   that differs is a collision: from there on its conversation goes by a digest of that turn as well, and the groups are
   made and verified anew.
3. Rollup. A node belongs to the smallest conversation through it, and so do its tokens and, if it has no children, its
   leaf. One scan from the end of every conversation backwards adds up what it owns at or below each place; the sum of that
   over a node's conversations is the sum over its subtree. Levels are not walked one by one.
4. Digests of the ids that end at a node stream over sorted pieces, of which a range of the sort makes some.

Groups of any size are counted by partial aggregation; what they are joined with is salted by count.

Defined cases: turns are in order of `turn`, null first, and then of role and text; a null role or text is empty; rows
without a conv_id belong to no conversation; repeated rows are turns like others; turns of any length count whole; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, matched, stored
from .spans import BASES, BYTES, NOT_SPACE, P, blocks, fold, hashes, mix, powers, runs, slices, sums

_U = np.uint64
NODE = ("depth", "fp", "salt")
#: Bytes of joined ids in one piece.
PIECE = 1 << 16


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo P, of any places."""
    high, of = np.unique(at >> 16, return_inverse=True)
    far = np.array([pow(base, int(h) << 16, P) for h in high], _U)[of]
    return fold(powers(base, 1 << 16)[at & 0xFFFF] * far)


class Scan:
    """Sums along the rows of one key, in order, over a table that is sorted and cut: polynomials modulo P for a base
    above 1, plain sums for base 1."""

    def __init__(self, key: str, values: Callable[[pa.RecordBatch], list[np.ndarray]], bases: Sequence[int]):
        self.key, self.values, self.bases = key, values, tuple(bases)

    def advance(self, batch: pa.RecordBatch, state):
        """Places from 0, sums with and without each row, whether a row begins its key, and the state after the batch."""
        key = batch.column(self.key).to_numpy()
        at = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        goes_on = state is not None and state[0] == key[0]
        new[0] = not goes_on
        start = np.maximum.accumulate(np.where(new, at, -1))
        open_ = start < 0  # what continues the rows before
        place = np.where(open_, at + (state[1] if goes_on else 0), at - start)
        sums_, before = [], []
        for k, (v, base) in enumerate(zip(self.values(batch), self.bases, strict=True)):
            term = v.astype(_U) if base == 1 else fold(v.astype(_U) * power(base, place))
            c = np.cumsum(term)
            carried = np.where(open_, _U(state[2][k]) if goes_on else _U(0), _U(0))
            s = c - np.where(open_, _U(0), c[np.maximum(start, 0)] - term[np.maximum(start, 0)]) + carried
            b = s - term
            if base > 1:
                s = fold(s)
                b = fold(s + _U(P) - term)
            sums_.append(s)
            before.append(b)
        return place, sums_, before, new, (int(key[-1]), int(place[-1]) + 1, [int(s[-1]) for s in sums_])

    def _ends(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first, parts = None, None, 0
        for batch in slices(batches):
            if batch.num_rows:
                _, _, _, new, state = self.advance(batch, state)
                parts += int(new.sum())
                first = int(batch.column(self.key)[0].as_py()) if first is None else first
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "whole": parts == 1, "last": state[0], "n": state[1], "sums": state[2]}], pa.schema([("part", pa.int32()), ("first", pa.int64()), ("whole", pa.bool_()), ("last", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    def states(self, rows: DataFrame) -> dict[int, tuple]:
        """What each partition that goes on with a key starts from."""
        ends = rows.mapInArrow(self._ends, "part int, first long, whole boolean, last long, n long, sums array<long>").collect()
        out, now = {}, None
        for e in sorted(ends, key=lambda e: e.part):
            state = (e.last, e.n, list(e.sums))
            if now is not None and now[0] == e.first:
                out[e.part] = now
                if e.whole:
                    state = (e.last, now[1] + e.n, [a + s if b == 1 else (a + pow(b, now[1], P) * s) % P for a, s, b in zip(now[2], e.sums, self.bases, strict=True)])
            now = state
        return out

    def run(self, rows: DataFrame, emit: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
        """emit(batch, places, sums, sums before, begins) gives the columns of each batch."""
        states, advance = self.states(rows), self.advance

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = states.get(TaskContext.get().partitionId())
            for batch in slices(batches):
                if batch.num_rows:
                    place, s, before, new, state = advance(batch, state)
                    yield pa.RecordBatch.from_pydict(emit(batch, place, s, before, new))

        return rows.mapInArrow(go, schema)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` sorted over all partitions, which stay as they are from now on."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order))


def cleaned(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _sorted(turns: DataFrame) -> DataFrame:
    return in_order(turns, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of cleaned turns."""
    emit = lambda batch, place, s, before, new: {"conv_id": batch.column("conv_id"), "place": pa.array(place + 1), "role": batch.column("role"), "text": batch.column("text")}
    return Scan("conv_id", lambda batch: [], []).run(_sorted(turns), emit, "conv_id long, place long, role string, text string")


def with_shared_heads(turns: DataFrame, share: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with heads from a neighbour: the first h turns of conversation c - c % share (all if fewer, none if
    absent) and then c's own after its first h, where h is crc32 of the decimal c, modulo `heads`.

    Returns turns (conv_id, turn, role, text) and all conversations (conv_id), those left without turns included.
    """
    own = cut(numbered(cleaned(turns)))
    size = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    size = cut(size.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base")))
    told = size.join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left")
    told = cut(told.select("conv_id", "h", "base", F.least("h", F.coalesce("of_base", F.lit(0))).alias("m")))
    first = own.where(F.col("place") < heads).withColumnRenamed("conv_id", "base")
    borrowed = told.where("m > 0").join(first, "base").where("place <= m").select("conv_id", F.col("place").alias("turn"), "role", "text")
    rest = own.join(told, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("turn"), "role", "text")
    return borrowed.union(rest), size.select("conv_id")


def turn_hash(role: pa.Array, text: pa.Array) -> np.ndarray:
    """62 bits of every role and text together."""
    out = []
    for column in (role, text):
        found = [np.zeros(0, _U)]
        for _, _, data, offsets in blocks(column):
            found.append(hashes(sums(BYTES[data]), offsets[:-1], offsets[1:]) ^ mix(np.diff(offsets).astype(_U) + _U(1)))
        out.append(np.concatenate(found))
    return mix(mix(out[0] + _U(1)) * _U(3) ^ out[1]) >> _U(2)


def word_counts(text: pa.Array) -> np.ndarray:
    found = [np.zeros(0, "i8")]
    for _, _, data, offsets in blocks(text):
        found.append(np.diff(runs(NOT_SPACE[data], offsets)[2]))
    return np.concatenate(found)


def prefixes(turns: DataFrame, keep: int = (1 << 62) - 1) -> DataFrame:
    """conv_id, depth, role, text, words, fp and fp_before: the fingerprints of the prefix with and without the turn.

    `keep` masks the turns' hashes, to force collisions in tests.
    """

    def values(batch):
        x = turn_hash(batch.column("role"), batch.column("text")) & _U(keep)
        return [(x >> _U(31 * k)) & _U(P) for k in range(2)]

    def emit(batch, place, s, before, new):
        both = lambda v: pa.array(((v[0] << _U(31)) | v[1]).view("i8"))
        return {"conv_id": batch.column("conv_id"), "depth": pa.array(place + 1), "role": batch.column("role"), "text": batch.column("text"), "words": pa.array(word_counts(batch.column("text"))), "fp": both(s), "fp_before": both(before)}

    return Scan("conv_id", values, BASES).run(_sorted(cleaned(turns)), emit, "conv_id long, depth long, role string, text string, words long, fp long, fp_before long")


def verified(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """`rows` of prefixes with salt and salt_before (0 but after a collision): equal depth, fp and salt are equal prefixes."""
    rows = stored(rows.withColumn("salt", F.lit(0).cast("long")).withColumn("salt_before", F.lit(0).cast("long")))
    node, tags = F.struct(*NODE).alias("node"), None
    for turn in range(rounds):
        groups = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
        heads = stored(groups.join(rows.select("conv_id", *NODE, "role", "text"), ["conv_id", *NODE]).select(node, "c", F.col("role").alias("head_role"), F.col("text").alias("head_text")))
        asked = rows.select("conv_id", "depth", "role", "text", node)
        odd = matched(asked, heads, "node").where("role <> head_role or text <> head_text")
        odd = cut(odd.select("conv_id", F.col("depth").alias("at"), F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("tag"), F.lit(turn).alias("round")))
        if odd.isEmpty():
            return rows
        tags = odd if tags is None else cut(tags.union(odd))
        # a conversation with collisions goes by all of them up to a place; others have none
        hit = tags.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "round", "tag"))).alias("hits"))
        upto = lambda last: F.when(F.size(F.filter("hits", lambda x: x["at"] <= last)) > 0, F.xxhash64(F.to_json(F.filter("hits", lambda x: x["at"] <= last)))).otherwise(F.lit(0).cast("long"))
        rows = stored(rows.drop("salt", "salt_before").join(hit, "conv_id", "left").withColumn("salt", upto(F.col("depth"))).withColumn("salt_before", upto(F.col("depth") - 1)).drop("hits"))
    raise RuntimeError(f"prefixes still collide after {rounds} rounds")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted partition as text, comma-joined, in pieces of one node each."""
    for batch in slices(batches, 10_000):
        key = [batch.column(k).to_numpy() for k in NODE]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        ids = batch.column("conv_id").to_pylist()
        starts = np.flatnonzero(new | (np.arange(len(ids)) % (PIECE // 16) == 0)).tolist()
        ends = [*starts[1:], len(ids)]
        yield pa.RecordBatch.from_pydict({name: pa.array(k[starts]) for name, k in zip(NODE, key, strict=True)} | {"first": pa.array([ids[a] for a in starts], pa.int64()), "ids": pa.array([",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=True)], pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its pieces, which follow each other in order."""
    now, h = None, None
    kinds = [("depth", pa.int64()), ("fp", pa.int64()), ("salt", pa.int64()), ("ends_sha256", pa.string())]
    for batch in slices(batches):
        out = []
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids")), strict=True):
            if key != now:
                if h is not None:
                    out.append((*now, h.hexdigest()))
                now, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({k: pa.array([o[i] for o in out], kind) for i, (k, kind) in enumerate(kinds)})
    if h is not None:
        yield pa.RecordBatch.from_pydict({k: pa.array([v], kind) for (k, kind), v in zip(kinds, (*now, h.hexdigest()), strict=True)})


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, fp, salt, ends_sha256 of the conversations (conv_id) that end at each node."""
    count = cut(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("c"), F.min("conv_id").alias("conv_id")))
    one = count.where("c = 1").select(*NODE, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = count.where("c > 1").select(F.struct(*NODE).alias("node"), "c")
    rows = matched(ends.select("conv_id", F.struct(*NODE).alias("node")), several, "node").select("node.*", "conv_id")
    pieces = rows.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_pieces, "depth long, fp long, salt long, first long, ids string")
    streams = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, fp long, salt long, ends_sha256 string")
    return one.union(streams)


def nodes(turns: DataFrame, conversations: DataFrame | None = None, keep: int = (1 << 62) - 1) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `conversations` (conv_id, each once) may name conversations without turns; else those of `turns` are all.
    """
    rows = verified(prefixes(turns, keep))
    ids = (rows.select("conv_id").distinct() if conversations is None else conversations.where("conv_id is not null")).select("conv_id")
    whole = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    node = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("fp_before").alias("fp_before"), F.min("salt_before").alias("salt_before"))
    node = cut(node)
    above = node.groupBy((F.col("depth") - 1).alias("depth"), F.col("fp_before").alias("fp"), F.col("salt_before").alias("salt")).agg(F.count(F.lit(1)).alias("n_children"))
    node = cut(node.join(above, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # what a conversation owns: the tokens that its nodes save, and its leaf
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    own = node.select("conv_id", "depth", saved, (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = rows.select("conv_id", *NODE).join(own, ["conv_id", "depth"], "left").select("conv_id", *NODE, F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    path = in_order(path, F.col("conv_id"), F.col("depth").desc())

    def emit(batch, place, s, before, new):
        return {k: batch.column(k) for k in ("conv_id", *NODE)} | {"saved": pa.array(s[0].view("i8")), "leaves": pa.array(s[1].view("i8")), "ends": pa.array(place == 0)}

    values = lambda batch: [batch.column("saved").to_numpy(), batch.column("leaf").to_numpy()]
    below = stored(Scan("conv_id", values, (1, 1)).run(path, emit, "conv_id long, depth long, fp long, salt long, saved long, leaves long, ends boolean"))
    total = below.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = below.where("ends").select("conv_id", *NODE)
    zero = F.lit(0).cast("long")
    turnless = ids.join(ends.select("conv_id"), "conv_id", "left_anti").select("conv_id", *[zero.alias(k) for k in NODE])
    digest = end_digests(cut(ends.union(turnless)))
    # parents: the root is known, the others may have very many children
    parents = node.where("n_children > 0").select(F.struct(*NODE).alias("node"), F.col("n_children").alias("c"), F.col("conv_id").alias("parent_conv_id"))
    deep = node.where("depth > 1").select("conv_id", F.col("depth").alias("d"), F.struct((F.col("depth") - 1).alias("depth"), F.col("fp_before").alias("fp"), F.col("salt_before").alias("salt")).alias("node"))
    deep = matched(deep, cut(parents), "node").select("conv_id", F.col("d").alias("depth"), "parent_conv_id")
    out = node.join(total, list(NODE)).join(deep, ["conv_id", "depth"], "left")
    least = F.lit(whole["least"]).cast("long")
    out = out.select(*NODE, "conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    top = node.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), zero).alias("leaves"), F.coalesce(F.sum(saved), zero).alias("saved_tokens"))
    n = F.lit(whole["n"]).cast("long")
    top = top.where(n > 0).select(*[zero.alias(k) for k in NODE], least.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), n.alias("n_convs"), "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.union(top).join(digest, list(NODE), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
