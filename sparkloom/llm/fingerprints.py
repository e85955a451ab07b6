"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A document's shingles are its runs of `WIDTH` characters (code points). Its sketch keeps every shingle hash below a fixed
fraction of all hashes, so that sketches of documents of any sizes are samples by one rule: the hashes that two of them
share below the threshold estimate how much of the smaller one the larger holds. A sketch of a union is the union of the
sketches. Where the fraction leaves fewer than `LEAST` hashes, the smallest `LEAST` are kept and the sketch carries a
threshold of its own, up to which it is complete, so that short texts have sketches too; two sketches are compared below
the lower of their thresholds.

A fingerprint is text: the threshold in 16 hexadecimal digits, and the sorted 64-bit hashes in base 64. Equal texts have
equal fingerprints.

The neighbour of a document is found without moving texts: ids alone are put in order, over ranges. A document's text
goes through one shuffle, and to its neighbour go only the characters asked for and its sketch.

Defined cases: a null text is empty; an empty text has an empty sketch, like only to that of another empty text; a text
shorter than a shingle is one shingle; ids in descending order, a null id (and -2**63) after all others; rows that share
an id have the same neighbour, which is, where several rows have its id, the one whose text's 64-bit hash is least; with
one id only, that id's own least row is everyone's neighbour; repeated rows come out as often as they came in; very long
texts are taken in parts; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stats import with_next
from .common import cut
from .spans import BYTES, blocks, hashes, slices, sums

WIDTH = 10
#: Of 2**64 hashes, those below 2**64 / SCALE are kept, and LEAST in any case.
SCALE, LEAST = 32, 32
PART = 1 << 20
ALL = (1 << 64) - 1
_LAST = (1 << 63) - 1
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every shingle of a block's texts, each text's first one and its first code point (n + 1 numbers each)."""
    points = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(points, offsets)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    end = begin + np.repeat(np.minimum(n, width), count)
    return hashes(sums(BYTES[data]), points[begin], np.append(points, len(data))[end]), at, first


def sketch(h: np.ndarray, scale: int = SCALE, least: int = LEAST) -> tuple[int, np.ndarray]:
    """Threshold and sorted hashes below it, of shingle hashes or of several sketches' hashes."""
    bar = ALL // scale
    few = np.unique(h[h < _U(bar)])
    if len(few) >= least:
        return bar, few
    if len(h) > 8 * least:  # the least of them are likely below this
        low = np.unique(h[h < _U(min(ALL, ALL // len(h) * 3 * least))])
        if len(low) > least:
            return int(low[least]), low[:least]
    low = np.unique(h)
    return (int(low[least]), low[:least]) if len(low) > least else (ALL, low)


def _long(data: np.ndarray, width: int) -> np.ndarray:
    """What may be in the sketch of one long text, a part at a time."""
    found = []
    for at in range(0, len(data), PART):
        some = data[at : at + PART + 4 * width + 4]
        points = np.flatnonzero((some & 0xC0) != 0x80)
        starts = np.arange(np.searchsorted(points, PART))
        if at + len(some) < len(data):
            edge = np.append(points, len(some))
        else:  # the last shingles end with the text
            edge = np.append(points, len(some))
            starts = starts[starts + width <= len(points)]
        h = np.unique(hashes(sums(BYTES[some]), points[starts], edge[starts + width]))
        found.append(np.union1d(h[: LEAST + 1], h[h < _U(ALL // SCALE)]))
    return np.concatenate(found)


def sketches(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """The sketch of every text of a column without nulls."""
    for first, last, data, offsets in blocks(column):
        if last == first + 1 and len(data) > 2 * PART:
            yield sketch(_long(data, width))
            continue
        h, at, _ = shingles(data, offsets, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield sketch(h[a:b])


def packed(s: tuple[int, np.ndarray]) -> bytes:
    return s[0].to_bytes(8, "big") + s[1].astype("<u8").tobytes()


def unpacked(raw: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(raw[:8], "big"), np.frombuffer(raw, "<u8", offset=8)


def to_text(raw: bytes) -> str:
    return raw[:8].hex() + base64.b64encode(raw[8:]).decode()


def from_text(fingerprint: str) -> bytes:
    return bytes.fromhex(fingerprint[:16]) + base64.b64decode(fingerprint[16:])


def merge(a: bytes, b: bytes) -> bytes:
    """The sketch of two documents together, complete up to the lower threshold."""
    (s, x), (t, y) = unpacked(a), unpacked(b)
    both = np.union1d(x, y)
    return packed((min(s, t), both if s == t == ALL else both[both < _U(min(s, t))]))


def likeness(a: bytes, b: bytes) -> float:
    """Share of the smaller document's shingles that the larger one holds, as estimated below both thresholds."""
    if a == b:
        return 1.0
    (s, x), (t, y) = unpacked(a), unpacked(b)
    if min(s, t) < ALL:
        bar = _U(min(s, t))
        x, y = x[: np.searchsorted(x, bar)], y[: np.searchsorted(y, bar)]
    least = min(len(x), len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / least if least else 0.0


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("_text")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([to_text(packed(s)) for s in sketches(column)], pa.string())], ["row", "made"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    made = rows.mapInArrow(run, rows.select("row").schema.add("made", "string"))
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], F.col("made").alias(out))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed for the shuffle that they go through."""
    press = zstandard.ZstdCompressor(3)
    for batch in slices(batches):
        yield pa.RecordBatch.from_pydict({"_o": batch.column("_o"), "_th": batch.column("_th"), "z": pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())})


def _unzipped(column: pa.Array) -> list[str]:
    back = zstandard.ZstdDecompressor()
    return [back.decompress(z).decode() for z in column.to_pylist()]


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document that asks its neighbour: the characters it wants, and the neighbour's sketch."""
    for batch in slices(batches):
        plain = _unzipped(batch.column("z"))
        text = pa.array(plain, pa.large_string())
        keys = list(zip(batch.column("_o").to_pylist(), batch.column("_th").to_pylist(), strict=True))
        one = [k for k, key in enumerate(keys) if not k or key != keys[k - 1]]  # rows of one text follow each other
        of = np.cumsum(np.isin(np.arange(len(keys)), one)) - 1
        made = [packed(s) for s in sketches(text.take(pa.array(one, pa.int32())))]
        press = zstandard.ZstdCompressor(3)
        yield pa.RecordBatch.from_pydict({
            "_o": batch.column("asker_o"),
            "_th": batch.column("asker_th"),
            "more": pa.array([press.compress(t[:k].encode()) for t, k in zip(plain, batch.column("k").to_pylist(), strict=True)], pa.binary()),
            "sketch": pa.array([made[k] for k in of.tolist()], pa.binary()),
        })


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text = _unzipped(batch.column("z"))
        edited = [t[: len(t) - len(t) // 3] + m[: len(t) // 3] for t, m in zip(text, _unzipped(batch.column("more")), strict=True)]
        own = [packed(s) for s in sketches(pa.array(text, pa.large_string()))]
        new = [packed(s) for s in sketches(pa.array(edited, pa.large_string()))]
        yield pa.RecordBatch.from_pydict({
            "_o": batch.column("_o"),
            "n_chars": pa.array([len(t) for t in text], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            "fingerprint": pa.array([to_text(s) for s in own]),
            "edited_fingerprint": pa.array([to_text(s) for s in new]),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, batch.column("sketch").to_pylist(), strict=True)], pa.float64()),
        })


OUT = "_o long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its characters replaced by as many of the neighbour's first ones, or all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(_LAST)).alias("_o"), F.xxhash64(text).alias("_th"))
    rows = rows.mapInArrow(_zipped, "_o long, _th long, z binary")
    ids = cut(docs.select(F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(_LAST)).alias("_o"), F.xxhash64(text).alias("_th"), F.floor(F.length(text) / 3).cast("int").alias("k")).distinct())
    one = ids.groupBy("_o").agg(F.min("_th").alias("next_th"))
    least = one.agg(F.min("_o")).first()[0]
    after = with_next(one.select("_o"), "_o").select("_o", F.coalesce("next", F.lit(least)).alias("next_o"))
    after = after.join(one.select(F.col("_o").alias("next_o"), "next_th"), "next_o")
    asks = ids.join(after, "_o").select(F.col("_o").alias("asker_o"), F.col("_th").alias("asker_th"), "k", F.col("next_o").alias("_o"), F.col("next_th").alias("_th"))
    given = rows.join(asks, ["_o", "_th"]).mapInArrow(_given, "_o long, _th long, more binary, sketch binary")
    given = given.groupBy("_o", "_th").agg(F.first("more").alias("more"), F.first("sketch").alias("sketch"))  # repeated rows give the same
    out = rows.join(given, ["_o", "_th"]).select("_o", "z", "more", "sketch").mapInArrow(_compared, OUT)
    return out.select(F.when(F.col("_o") != _LAST, F.bitwise_not("_o")).alias("doc_id"), *[c for c in out.columns if c != "_o"])
