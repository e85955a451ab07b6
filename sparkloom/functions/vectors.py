"""Embeddings: cosine similarity, top-k search, packed bytes, and embedding by ONNX models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from ..model import Model, scorer

MOST_K = 10_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths, zero vectors and components that are null or not finite."""
    fine = lambda v: F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    ok = (F.size(a) == F.size(b)) & fine(a) & fine(b)
    return F.when(ok, F.coalesce(F.try_divide(_dot(a, b), norm), F.lit(0.0))).otherwise(0.0)


def _query(query: Sequence[float]) -> Column:
    q = np.array(query, "f8")
    if not len(q) or not np.isfinite(q).all() or not (q * q).sum() > 0:
        raise ValueError("the query must be finite and not zero")
    return F.array(*[F.lit(float(v)) for v in q])


def similar(df: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.0, row_id: str = "row_id", embedding: str = "embedding") -> DataFrame:
    """row_id and score of the k rows most like `query`, of those at or above the threshold; ties go to the smaller id."""
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be from 1 to {MOST_K}")
    score = F.round(cosine(F.col(embedding), _query(query)), 6).alias("score")
    out = df.where(F.col(embedding).isNotNull()).select(F.col(row_id).alias("row_id"), score)
    return out.where(F.col("score") >= max(-1.0, min(1.0, threshold))).orderBy(F.desc("score"), "row_id").limit(k)


def scan_counts(df: DataFrame, query: Sequence[float], embedding: str = "embedding") -> DataFrame:
    """scanned, skipped_null and other_length of a search's candidates."""
    e = F.col(embedding)
    return df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(e.isNull()).alias("skipped_null"), F.count_if(e.isNotNull() & (F.size(e) != len(query))).alias("other_length"))


@F.arrow_udf(BinaryType())
def _pack(values: pa.Array) -> pa.Array:
    """The values buffer of a batch is the bytes of all its rows already."""
    size, data = values.value_lengths().fill_null(0).to_numpy(), values.flatten()
    ends = np.concatenate([[0], np.cumsum(size, dtype="i8")]) * 4
    raw = np.ascontiguousarray(data.cast(pa.float32()).to_numpy(zero_copy_only=False), "<f4")
    out = pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return pc.if_else(values.is_valid(), out, None).cast(pa.binary())


@F.arrow_udf(ArrayType(FloatType()))
def _unpack(raw: pa.Array) -> pa.Array:
    whole = pc.equal(pc.bit_wise_and(pc.binary_length(raw), 3), 0).fill_null(False)
    kept = pc.if_else(whole, raw, pa.scalar(b"", raw.type)).cast(pa.large_binary())
    size = pc.binary_length(kept).to_numpy() // 4
    values = np.frombuffer(b"".join(kept.to_pylist()), "<f4")
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))
    return pc.if_else(whole, out, None)


def pack(column: Column) -> Column:
    """An array of floats as little-endian 32-bit bytes."""
    return _pack(column)


def unpack(column: Column) -> Column:
    """What `pack` gives, as an array; null for a length that isn't a multiple of four."""
    return _unpack(column)


def from_text(column: Column) -> Column:
    """The bytes that a text stands for: pairs of hexadecimal digits, or else characters and \\xNN escapes."""
    tokens = F.regexp_extract_all(column, F.lit(r"(?s)(\\x[0-9A-Fa-f]{2}|.)"))
    digits = F.transform(tokens, lambda t: F.when(F.length(t) == 4, F.substring(t, 3, 2)).otherwise(F.hex(F.encode(t, "UTF-8"))))
    return F.when(column.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(column)).otherwise(F.unhex(F.array_join(digits, "")))


@scorer("onnx")
def _onnx(state: dict, x: list[Column]) -> Column:
    """The first number that the model's output holds for a row."""

    @F.arrow_udf(DoubleType())
    def first(values: pa.Array) -> pa.Array:
        session, name = _session(state["path"])
        rows = np.array(values.to_pylist(), "f4").reshape(len(values), -1)
        return pa.array(_answers(session, name, rows)[:, 0].astype("f8"))

    return first(F.array(*[c.cast("float") for c in x]))


@lru_cache(maxsize=4)
def _session(path: str):
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    have = [o.name for o in session.get_outputs()]
    return session, next((n for n in ("pooler_output", "text_embeds", "last_hidden_state") if n in have), have[0])


def _answers(session, name: str, x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros((0, 1), "f4")
    y = np.asarray(session.run([name], {session.get_inputs()[0].name: x})[0])
    return (y[:, 0] if y.ndim == 3 else y).reshape(len(x), -1).astype("f4")


def load_onnx(path: str, features: Sequence[str]) -> Model:
    """A model file, which every executor must be able to open, as a model that the registry and pipelines take."""
    return Model("onnx", list(features), {"path": path})


def onnx_outputs(df: DataFrame, path: str, features: Sequence[str], out: str = "embedding") -> DataFrame:
    """`df` with the vector that an ONNX model gives for its feature columns.

    `path` is a file that every executor can open. The first of the outputs pooler_output, text_embeds,
    last_hidden_state, or else the model's first is taken; of a sequence the first position.
    """
    names = list(features)
    inner = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.array(*[F.col(c).cast("float") for c in names]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, name = _session(path)
        for batch in batches:
            y = _answers(session, name, np.array(batch.column("x").to_pylist(), "f4").reshape(batch.num_rows, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(list(y), pa.list_(pa.float32()))], ["row", out])

    return inner.mapInArrow(run, inner.select("row").schema.add(out, ArrayType(FloatType()))).select("row.*", out)
