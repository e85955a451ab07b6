"""Byte-level BPE encoding and decoding by overlapping chunks.

1. Texts over `chunk` characters are cut into chunks that overlap by `overlap` characters on either side, and each chunk
   is pre-tokenised alone. Texts over `spread` characters have chunks of that size, dealt over all tasks; shorter ones
   stay in their task.
2. Stitch. A pre-token boundary that two neighbouring chunks share resynchronises them: from one boundary on, the
   pattern matches alike in both. The stitch keeps the left chunk's boundaries up to the first shared one and the right
   chunk's after it. Where the overlap has none (one very long word), it pre-tokenises on through the text itself until
   it meets a boundary of the right chunk, or the end.
3. The pieces between the stitched boundaries are encoded; those of dealt texts over all tasks again, and joined last.
   Decoding concatenates the raw bytes of the ids.

Defined cases: null text counts as empty (no tokens; the digests of nothing); rows that repeat give a row each, and long
ones are encoded once; an empty table gives no rows; columns besides doc_id and text are ignored; null doc_id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed
from .spans import slices

#: Pieces whose ids a worker keeps, about 30 MB; then it starts over.
CACHE_PIECES = 200_000


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PieceEncoder:
    """Ids of pre-tokens, kept for the pieces seen lately."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, k in ranks.items():
            self.bytes_of[k] = raw
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            got = np.array(self.bpe.encode_ordinary(piece), "<u4").tobytes()
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            if len(piece) < 64:
                self.cache[piece] = got
        return got

    def encode(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            return b"".join(map(self.piece, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _result(enc: PieceEncoder, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()


KINDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_starts(enc: PieceEncoder, text: str, lo: int, last: bool) -> np.ndarray:
    """Where the pieces of a chunk that begins at `lo` start in the whole text, and where the last one ends.

    The last piece of a chunk that isn't the text's last may go on beyond it, so it is left out.
    """
    pieces = enc.pattern.findall(text)
    if not last and pieces:
        pieces.pop()
    return np.fromiter(accumulate(map(len, pieces), initial=lo), "i8", len(pieces) + 1)


def stitch(enc: PieceEncoder, chunks: list[np.ndarray], text_at: Callable[[int, int], str], total: int) -> np.ndarray:
    """Where the pieces of the whole text start, and its end, from the chunks' starts in order."""
    out: list[np.ndarray] = []
    at = 0  # a true boundary: all before it is done
    for k, starts in enumerate(chunks):
        last = k + 1 == len(chunks)
        i = int(np.searchsorted(starts, at))
        if i == len(starts) or starts[i] != at:  # not in step: go on through the text until a start of this chunk
            stop, grown, walked = int(starts[-1]), 4096, []
            while at < total and (last or at < stop) and (i == len(starts) or starts[i] != at):
                some = text_at(at, min(total, at + grown))
                end = enc.pattern.match(some).end()
                if end == len(some) and at + grown < total:
                    grown *= 2  # the piece may go on
                    continue
                walked.append(at)
                at, grown = at + end, 4096
                i = int(np.searchsorted(starts, at))
            out.append(np.array(walked, "i8"))
            if i == len(starts) or starts[i] != at:
                continue
        j = len(starts) - 1  # leave this chunk at the first start that the next one shares
        if not last:
            both = np.intersect1d(starts[i:], chunks[k + 1], assume_unique=True)
            if len(both):
                j = i + int(np.searchsorted(starts[i:], both[0]))
        out.append(starts[i:j])
        at = int(starts[j])
    return np.concatenate([*out, [total]]).astype("i8")


def pieces_of(enc: PieceEncoder, text: str, chunk: int, overlap: int) -> list[str]:
    """The pre-tokens of a text, by overlapping chunks."""
    n = len(text)
    if n <= chunk:
        return enc.pattern.findall(text)
    ends = [(max(0, lo - overlap), min(n, lo + chunk + overlap)) for lo in range(0, n, chunk)]
    at = stitch(enc, [chunk_starts(enc, text[a:b], a, b == n) for a, b in ends], lambda a, b: text[a:b], n).tolist()
    return [text[a:b] for a, b in pairwise(at)]


def _whole(path: str, chunk: int, overlap: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, 500):
            rows, all_ids = [], []
            for t in batch.column("text").to_pylist():
                ids = enc.encode(pieces_of(enc, t, chunk, overlap))
                rows.append(_result(enc, ids))
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype("i4"))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if with_ids:
                cols["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _boundaries(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            batch["_starts"] = [chunk_starts(enc, t, lo, last).astype("<i8").tobytes() for t, lo, last in zip(batch["_part"], batch["_lo"], batch["_last"], strict=True)]
            yield batch

    return run


def _stitcher(path: str, chunk: int):
    """A long text's pieces in parts that end at true boundaries, to be encoded anywhere."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_lo")
        lows, parts, total = group["_lo"].tolist(), group["_part"].tolist(), int(group["_n"].iloc[0])
        ends = [*lows[1:], total]
        text_at = lambda a, b: "".join(t[max(a, lo) - lo : min(b, end) - lo] for lo, t, end in zip(lows, parts, ends, strict=True) if lo < b and end > a)
        at = stitch(encoder(path), [np.frombuffer(s, "<i8") for s in group["_starts"]], text_at, total)
        cut = np.unique([*np.searchsorted(at, np.arange(0, total, chunk)), len(at) - 1])
        rows = [(int(at[i]), text_at(int(at[i]), int(at[j])), np.diff(at[i : j + 1]).astype("<i4").tobytes()) for i, j in pairwise(cut)]
        out = pd.DataFrame(rows, columns=["_lo", "_part", "_sizes"])
        return out.assign(**{k: group[k].iloc[0] for k in ("_id", "_th", "_copies")})

    return run


def _encoded(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            ids = []
            for text, sizes in zip(batch["_part"], batch["_sizes"], strict=True):
                at = [0, *accumulate(np.frombuffer(sizes, "<i4").tolist())]
                ids.append(enc.encode([text[a:b] for a, b in pairwise(at)]))
            yield batch[["_id", "_th", "_copies", "_lo"]].assign(_ids=ids)

    return run


def _joiner(path: str, with_ids: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(group.sort_values("_lo")["_ids"])
        n, a, b = _result(encoder(path), ids)
        out = pd.DataFrame({"_id": group["_id"].iloc[:1], "_copies": group["_copies"].iloc[:1], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})
        if with_ids:
            out["ids"] = [np.frombuffer(ids, "<u4").astype("i4")]
        return out

    return run


def encode(docs: DataFrame, path: str | None = None, chunk: int = 2048, overlap: int = 256, spread: int = 32768, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for)."""
    path = path or ranks_path()
    more = ", ids array<int>" * with_ids
    rows = keyed(docs)
    n = F.length("text")
    short = rows.where(n <= spread).select("doc_id", "text").mapInArrow(_whole(path, chunk, overlap, with_ids), KINDS + more)
    # rows that repeat id and text are one, with a count
    long = rows.where(n > spread).groupBy("_id", "_th").agg(F.count("*").alias("_copies"), F.first("text").alias("text"))
    long = long.select("_id", "_th", "_copies", n.alias("_n"), "text", F.explode(F.sequence(F.lit(0), n - 1, F.lit(spread))).alias("_from"))
    # each chunk reaches `overlap` characters into both neighbours
    lo, hi = F.greatest(F.col("_from") - overlap, F.lit(0)), F.least(F.col("_from") + spread + overlap, F.col("_n"))
    long = long.select("_id", "_th", "_copies", F.col("_n").cast("long"), lo.cast("long").alias("_lo"), (hi >= F.col("_n")).alias("_last"), F.substring("text", lo + 1, hi - lo).alias("_part"))
    key = "_id long, _th long, _copies long"
    long = long.repartition("_id", "_th", "_lo").mapInPandas(_boundaries(path), f"{key}, _n long, _lo long, _last boolean, _part string, _starts binary")
    long = long.groupBy("_id", "_th").applyInPandas(_stitcher(path, spread), f"_lo long, _part string, _sizes binary, {key}")
    long = long.repartition("_id", "_th", "_lo").mapInPandas(_encoded(path), f"{key}, _lo long, _ids binary")
    long = long.groupBy("_id", "_th").applyInPandas(_joiner(path, with_ids), "_id long, _copies long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    each = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return short.union(long.withColumn("_each", each).select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids))
