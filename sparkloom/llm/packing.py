"""Packing of token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

1. One pass tokenises each whole text and cuts its ids every `size` tokens; a row per piece, without the ids.
2. Pieces are dealt into groups by a hash of the row, the piece and the row's number where it was read, so that neither
   copies of one row nor the pieces of one very long text meet; each group of about `group_pieces` pieces is packed alone.
   The pieces are checkpointed with that number, so that a rerun deals alike. No task grows with the input.
3. Within a group, pieces go in decreasing length to the first sequence with room. A complete binary tree over the
   sequences' free room (each inner node the larger of its children) finds that sequence in log time.

Defined cases: null text counts as empty and has the end token alone; equal lengths go by doc_id, text hash and start;
rows that repeat are packed each on its own; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed
from .spans import slices

END = 2
#: Ends each word in the byte-pair encoder's input; a text that holds it goes to the tokenizer as it is.
MARK = "\x01"
WORD_END = "</w>"
#: Words whose ids a worker keeps, about 30 MB; then it starts over.
CACHE_WORDS = 200_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts as bytes, by the words between spaces: the tokenizer's pieces never reach across white space.

    Words not seen lately are encoded many at a time: normalised, cut by the tokenizer's own pattern, each piece ended
    by MARK, and merged by its ranks with the end-of-word suffix written as MARK. Ids that end a piece show where each
    word ends.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks, self.is_end = {}, np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        for token, k in spec["model"]["vocab"].items():
            ends = token.endswith(WORD_END)
            raw = bytes(map(byte_of.__getitem__, token.removesuffix(WORD_END))) + MARK.encode() * ends
            ranks[raw] = k
            self.is_end[k] = ends
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tok(self):
        """The tokenizer itself, for what the words' way doesn't cover; few workers ever load it."""
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = True
        return tok

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        text = unicodedata.normalize("NFC", "\n".join(words)).replace("\u03a3", "\u03c3").lower()
        pieces = [self.pattern.findall(w) for w in text.split("\n")]
        flat = [p for x in pieces for p in x]
        ids = np.array(self.bpe.encode_ordinary(MARK.join(flat) + MARK) if flat else [], "<u4")
        last = np.concatenate([[0], np.flatnonzero(self.is_end[ids]) + 1]) * 4
        if len(last) != len(flat) + 1:
            return {w: self.plain(w) for w in words}
        at = last[np.concatenate([[0], np.cumsum([len(x) for x in pieces])])].tolist()
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, at[:-1], at[1:], strict=True)}

    def encode(self, text: str) -> bytes:
        if MARK in text:
            return self.plain(text)
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            cache = self.cache
            got = self._learn([w for w in dict.fromkeys(words) if w not in cache])
            if len(cache) > CACHE_WORDS:
                got = {w: cache[w] for w in words if w in cache} | got
                self.cache = cache = {}
            cache.update(got)
            return b"".join(map(cache.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END], "<u4").tobytes()
        done = 0
        for batch in slices(batches, 500):
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = encode(text) + end
                n = len(raw) // 4
                for start in range(0, n, size):
                    piece = raw[4 * start : 4 * (start + size)]
                    out["row"].append(row)
                    out["start"].append(start)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(n)
                    if with_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4").astype("i4"))
            take = pa.array(out.pop("row"), pa.int32())
            ids = out.pop("ids")
            cols = {k: batch.column(k).take(take) for k in ("doc_id", "_id", "_th")}
            cols["_row"] = pa.array(take.to_numpy().astype("i8") + done)
            done += batch.num_rows
            cols |= {k: pa.array(v, pa.int64()) for k, v in out.items()}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, given in decreasing order; a tournament tree over free room finds the first fit."""
    n = len(lengths)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [size] * (2 * leaves)  # node k has the children 2k and 2k + 1, and the larger room of both
    bins, offsets = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < need:
                k += 1
        bins[i], offsets[i] = k - leaves, size - room[k]
        room[k] -= need
        while k > 1:
            k //= 2
            top = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == top:
                break
            room[k] = top
    return bins, offsets


def _packer(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_id", "_th", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        return group.assign(sequence_id=(group["_group"].to_numpy("i8") << 32) | bins, offset=offsets).drop(columns=["_group", "_id", "_th"])

    return run


def pack(docs: DataFrame, size: int = 4096, group_pieces: int = 4000, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    kinds = "doc_id long, _id long, _th long, _row long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = keyed(docs).mapInArrow(_pieces(path or tokenizer_path(), size, with_ids), kinds)
    pieces = cut(pieces.withColumn("_deal", F.xxhash64("_id", "_th", "start", "_row", F.spark_partition_id())).drop("_row"))
    n_groups = max(1, -(-pieces.count() // group_pieces))
    pieces = pieces.withColumn("_group", F.pmod("_deal", F.lit(n_groups))).drop("_deal")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return pieces.groupBy("_group").applyInPandas(_packer(size), kinds + ", sequence_id long, offset long")
