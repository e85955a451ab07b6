"""Document quality by a linear-chain conditional random field over lines.

Every line gets a feature vector of its own shape, and those of its neighbours before and after it. The field labels
each line bad or good; forward-backward gives each line's marginal, and the marginals, weighted by the lines' lengths,
average into a document's share of good text. A two-parameter logistic curve turns the share into a probability.

Fitting uses a bounded sample of labelled teaching rows. Lines have no labels, so the first fit takes each line to be
as its document is; a second fit takes a line of a bad document as bad only if the first one found it so.

Defined cases: null and empty texts have one empty line; lines end at \\n alone; with no teaching rows, or of one class
only, every score is that class's smoothed share; rows that repeat get a row each; null doc_id is scored and counts as
not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .learning import held_out, teaching_sample
from .spans import BYTES, NOT_SPACE, blocks, hashes, runs, slices, sums

_IS = {
    "upper": np.array([0x41 <= b <= 0x5A for b in range(256)]),
    "digit": np.array([0x30 <= b <= 0x39 for b in range(256)]),
    "mark": np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?" for b in range(256)]),
    "pipe": np.array([b == 0x7C for b in range(256)]),
    "bang": np.array([b == 0x21 for b in range(256)]),
    "stop": np.array([chr(b) in ".,;:?" for b in range(256)]),
    "high": np.array([b >= 0x80 for b in range(256)]),
}
#: Own features of a line: shares of its bytes by kind; of its words: repeats of the word before, repeats within the
#: line, length; whether it is empty, short or long.
OWN = len(_IS) + 6
WIDE = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line, each line's length in bytes, and each text's first line (n + 1 numbers)."""
    # a text of k newlines has k + 1 lines; every line's end is its newline or its text's end
    ends = np.sort(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]), kind="stable")
    # at a text's end that follows a newline at the same place, order doesn't matter: both lines end there
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[offsets]
    first = breaks + np.arange(len(offsets))
    is_last = np.zeros(len(ends), bool)
    is_last[first[1:] - 1] = True
    starts = np.empty(len(ends), "i8")
    starts[0:1] = 0
    starts[1:] = np.where(is_last[:-1], ends[:-1], ends[:-1] + 1)
    size = ends - starts
    x = np.zeros((len(ends), OWN), "f4")
    bulk = np.maximum(size, 1)
    for k, table in enumerate(_IS.values()):
        c = np.concatenate([[0], np.cumsum(table[data], dtype="i4")])
        x[:, k] = (c[ends] - c[starts]) / bulk
    w0, w1, _ = runs(NOT_SPACE[data], offsets)
    line = np.searchsorted(ends, w0, "right")
    line = np.where((line < len(ends)), line, len(ends) - 1)
    n = np.bincount(line, minlength=len(ends))
    words = np.maximum(n, 1)
    h = hashes(sums(BYTES[data]), w0, w1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    k = len(_IS)
    x[:, k] = np.bincount(line, weights=again, minlength=len(ends)) / words
    both = h ^ (line.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    twice = np.zeros(len(h), bool)
    twice[order[1:]] = both[order[1:]] == both[order[:-1]]
    x[:, k + 1] = np.bincount(line, weights=twice, minlength=len(ends)) / words
    x[:, k + 2] = np.minimum(np.bincount(line, weights=w1 - w0, minlength=len(ends)) / words / 10, 3)
    x[:, k + 3] = size == 0
    x[:, k + 4] = n <= 3
    x[:, k + 5] = np.minimum(np.log1p(n) / 5, 2)
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after within the text, and a constant."""
    out = np.zeros((len(x), WIDE), "f4")
    out[:, :OWN], out[:, -1] = x, 1
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = x[1:]
    out[first[:-1], OWN : 2 * OWN] = 0
    out[first[1:] - 1, 2 * OWN : 3 * OWN] = 0
    return out


def forward_backward(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every line (n x 2), summed marginals of neighbouring pairs (2 x 2), and the log partition.

    All chains advance together, the longest ones alone at last.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, count = first[:-1][order], count[order]
    u = np.exp(unary - unary.max(1, keepdims=True))
    t = np.exp(trans)
    n, longest = len(unary), int(count[0]) if len(count) else 0
    alpha, scale = np.zeros((n, 2)), np.ones(n)
    live = [int(np.searchsorted(-count, -k, "left")) for k in range(longest)]  # chains with more than k lines
    for k in range(longest):
        at = start[: live[k]] + k
        a = u[at] if not k else (alpha[at - 1] @ t) * u[at]
        scale[at] = z = a.sum(1)
        alpha[at] = a / z[:, None]
    beta = np.ones((n, 2))
    pair = np.zeros((2, 2))
    for k in range(longest - 2, -1, -1):
        at = start[: live[k + 1]] + k
        nxt = beta[at + 1] * u[at + 1] / scale[at + 1][:, None]
        beta[at] = nxt @ t.T
        pair += (alpha[at].T @ nxt) * t
    log_z = float(np.log(scale).sum() + unary.max(1).sum())
    return alpha * beta, pair, log_z


@dataclass
class Model:
    weights: np.ndarray  # WIDE x 2
    trans: np.ndarray  # 2 x 2
    curve: tuple[float, float]  # slope and shift of the share of good text
    base: float | None = None  # the constant score where nothing could be learnt


def good_share(model: Model, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's length-weighted share of good lines, and the lines' marginals."""
    good = forward_backward(with_neighbours(x, first) @ model.weights, model.trans, first)[0][:, 1]
    w = size + 1.0
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1]), good


def train_field(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood of the line labels `y` by Adam steps on the exact gradient."""
    wide = with_neighbours(x, first).astype("f8")
    hot = np.eye(2)[y]
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    p = np.zeros(WIDE * 2 + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        w, t = p[:-4].reshape(WIDE, 2), p[-4:].reshape(2, 2)
        marg, pair, _ = forward_backward(wide @ w, t, first)
        g = np.concatenate([(wide.T @ (marg - hot)).ravel(), (pair - seen).ravel()]) / len(y) + penalty * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return p[:-4].reshape(WIDE, 2), p[-4:].reshape(2, 2)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, labels = batch.column("doc_id"), batch.column("label")
        for a, b, data, offsets in blocks(batch.column("text")):
            x, size, first = line_features(data, offsets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.slice(a, b - a),
                "label": labels.slice(a, b - a),
                "x": pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                "size": pa.array([size[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()),
            })


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, characters: int = 30_000_000, rounds: int = 150) -> Model:
    """Fit on at most `most` labelled teaching rows of `characters` together, which bounds what the driver gets."""
    sample = teaching_sample(docs, labels, "quality", most, characters)
    rows = sample.select("doc_id", "label", "text").mapInArrow(_sampled, "doc_id long, label int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["label"] for r in rows], "i8")
    base = float((y.sum() + 1) / (len(y) + 2))
    none = Model(np.zeros((WIDE, 2)), np.zeros((2, 2)), (1.0, 0.0), base)
    if len(y) == 0 or y.min() == y.max():
        return none
    x = np.concatenate([np.frombuffer(r["x"], "f4").reshape(-1, OWN) for r in rows])
    size = np.concatenate([np.frombuffer(r["size"], "i8") for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r["size"]) // 8 for r in rows])])
    of = np.repeat(y, np.diff(first))
    model = Model(*train_field(x, of, first, rounds), (1.0, 0.0))
    _, good = good_share(model, x, size, first)
    of = np.where((of == 0) & (good > 0.5), 1, of)
    model = Model(*train_field(x, of, first, rounds), (1.0, 0.0))
    share, _ = good_share(model, x, size, first)
    # the curve: slope and shift by Newton steps on the logistic loss, lightly held to zero
    a = np.stack([share, np.ones(len(y))], 1)
    c = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        c = c - np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + 1e-2 * np.eye(2), a.T @ (p - y) + 1e-2 * c)
    return Model(model.weights, model.trans, (float(c[0]), float(c[1])))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = np.full(batch.num_rows, model.base if model.base is not None else 0.5)
            if model.base is None:
                for a, b, data, offsets in blocks(batch.column("text")):
                    share, _ = good_share(model, *line_features(data, offsets))
                    score[a:b] = 1 / (1 + np.exp(-np.clip(model.curve[0] * share + model.curve[1], -500, 500)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score)})

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **limits: int) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **limits)
    out = keyed(docs).select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
