"""Toxicity by weak supervision.

1. A bounded sample of labelled teaching rows gives voters: words (lexicon) and word beginnings (patterns) that are
   much likelier in rejected texts. Counting them is a Spark aggregation over the sample; the best few hundred stay.
2. A generative label model takes the votes of all voters, and the annotators' mark as one more noisy voter, on the
   sample. Expectation-maximisation estimates how often each votes under either truth (its accuracy). Where two voters'
   votes still go together given the truth, the later one depends on the earlier: its rates are estimated, and count, given
   what that one says (their correlation), so that copies of a voter add nothing.
3. A logistic model over the same features is fitted to the posterior labels, and scores every whole text.

Only the text is an input of the score. Defined cases: null and empty texts get the score of a text without any
feature; with no teaching rows, or of one class only, every score is that class's smoothed share; rows that repeat get
a row each; null doc_id is scored and counts as not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import keyed
from .learning import held_out, teaching_sample
from .spans import BYTES, LETTER, blocks, hashes, runs, slices, sums

#: Bytes of the word beginnings that make patterns; 0 is the whole word.
BEGINNINGS = (0, 3, 4, 5, 6, 7, 8)
_BITS = 20


#: Pattern voters on a whole text: at least so many words that show a feature, and so many in a thousand words.
DENSITIES = ((2, 0), (3, 0), (1, 5), (1, 10), (2, 8), (2, 12), (2, 16), (3, 16), (2, 25))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: hash of each word's feature, the word's number, and the text that it is in."""
    starts, ends, first = runs(LETTER[data], offsets)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    s = sums(BYTES[data])
    for size in BEGINNINGS:
        long = np.flatnonzero(ends - starts > size)
        yield hashes(s, starts[long], starts[long] + size if size else ends) ^ np.uint64(size), long, text_of[long]


def _present(column: pa.Array, wanted: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each block: first row, last row, and the votes of each text: of the sorted `wanted` features and DENSITIES."""
    m = len(wanted)
    for first, last, data, offsets in blocks(pc.utf8_lower(column)):
        has = np.zeros((last - first, m + len(DENSITIES)), bool)
        shows: list[np.ndarray] = []
        for size, (h, word, text) in zip(BEGINNINGS, features(data, offsets), strict=True):
            if not size:
                words, text_of = np.bincount(text, minlength=last - first), text
            maybe = np.flatnonzero(table[h >> np.uint64(64 - _BITS)])
            h = h[maybe]
            at = np.minimum(np.searchsorted(wanted, h), m - 1)
            hit = wanted[at] == h
            has[text[maybe[hit]], at[hit]] = True
            shows.append(word[maybe[hit]])
        hits = np.bincount(text_of[np.unique(np.concatenate(shows))], minlength=last - first)
        for k, (least, rate) in enumerate(DENSITIES):
            has[:, m + k] = (hits >= least) & (1000 * hits >= rate * words)
        yield first, last, has


def lookup(wanted: np.ndarray) -> np.ndarray:
    """Whether any wanted feature has these leading bits."""
    table = np.zeros(1 << _BITS, bool)
    table[wanted >> np.uint64(64 - _BITS)] = True
    return table


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that have each feature, summed over a block of a batch."""
    for batch in slices(batches):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in blocks(pc.utf8_lower(batch.column("text"))):
            for h, _word, text in features(data, offsets):
                pairs = np.unique(np.stack([h, text.astype("u8")]), axis=1) if len(h) else np.zeros((2, 0), "u8")
                uniq, at = np.unique(pairs[0], return_inverse=True)
                pos = np.bincount(at, weights=label[first + pairs[1].astype("i8")], minlength=len(uniq)).astype("i8")
                n = np.bincount(at, minlength=len(uniq)).astype("i8")
                yield pa.RecordBatch.from_pydict({"feature": pa.array(uniq.view("i8")), "pos": pa.array(pos), "neg": pa.array(n - pos)})


def _votes(wanted: np.ndarray):
    table = lookup(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [np.flatnonzero(row).astype("i4") for _, _, has in _present(batch.column("text"), wanted, table) for row in has]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "votes": pa.array(got, pa.list_(pa.int32()))})

    return run


@dataclass
class Model:
    wanted: np.ndarray
    weights: np.ndarray
    bias: float


def label_model(votes: np.ndarray, prior: float, rounds: int = 30, bound: float = 0.4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row's truth; rates[truth, what the parent says, voter]; and each voter's parent, or -1.

    `votes` is rows x voters, the last voter being the annotators' mark, which starts the estimation. The model is a
    forest over the voters: a voter depends on the truth and on at most one earlier voter, the one that correlates most
    with it, by over `bound`, once the truth is accounted for. A voter without a parent has its rates at 0.
    """
    v = votes.astype("f8")
    n, m = v.shape
    post = np.where(v[:, -1] > 0, 0.9, 0.1)
    parent = np.full(m, -1)
    said = np.zeros((n, m))  # what each voter's parent says
    both = v * said
    rates = np.zeros((2, 2, m))
    for step in range(rounds):
        for k, w in ((1, post), (0, 1 - post)):
            spoke, led, together = w @ v, w @ said, w @ both
            rates[k, 0] = (spoke - together + 0.5) / (w.sum() - led + 1)
            rates[k, 1] = (together + 0.5) / (led + 1)
        rates[1] = np.maximum(rates[1], rates[0])  # a voter never speaks against what it was chosen for
        if step in (2, 10):  # correlation that the truth leaves unexplained
            means = [(w @ v) / w.sum() for w in (1 - post, post)]
            left = v - np.outer(post, means[1]) - np.outer(1 - post, means[0])
            left -= left.mean(0)
            sd = np.sqrt((left**2).mean(0)) + 1e-9
            corr = np.tril(np.abs(left.T @ left) / n / np.outer(sd, sd), -1)
            parent = np.where(corr.max(1) > bound, corr.argmax(1), -1)
            said = np.where(parent >= 0, v[:, parent], 0.0)
            both = v * said
            continue  # the rates given the new parents come first
        # silence of a lexicon voter says little: it counts by its rate as well
        yes, no = np.log(rates[1]) - np.log(rates[0]), np.log1p(-rates[1]) - np.log1p(-rates[0])
        log_odds = np.log(prior / (1 - prior)) + no[0].sum() + v @ (yes[0] - no[0]) + said @ (no[1] - no[0]) + both @ (yes[1] - no[1] - yes[0] + no[0])
        post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        prior = float(np.clip(post.mean(), 0.01, 0.99))
    return post, rates, parent


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft labels, by damped Newton steps; the bias goes unpenalised."""
    n, m = x.shape
    x = np.hstack([x, np.ones((n, 1))])
    ridge = np.full(m + 1, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(m + 1)
    loss = lambda w: np.logaddexp(0, z := x @ w).sum() - y @ z + ridge @ w**2 / 2
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - then < 1e-8 * abs(now):
            break
        now = then
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, characters: int = 100_000_000, voters: int = 400, support: int = 6) -> Model:
    """Fit on at most `most` labelled teaching rows of `characters` together; what reaches the driver is bounded by most * voters."""
    sample = teaching_sample(docs, labels, "toxic", most, characters)
    counts = sample.select("text", "label").mapInArrow(_counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    pos, neg = n.get(1, 0), n.get(0, 0)
    base = (pos + 1) / (pos + neg + 2)
    none = Model(np.zeros(0, "u8"), np.zeros(0), float(np.log(base / (1 - base))))
    if not pos or not neg:
        return none
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    best = counts.where((F.col("pos") >= support) & (odds > 2)).orderBy((F.col("pos") * odds).desc(), "feature").limit(voters).select("feature").collect()
    if not best:
        return none
    wanted = np.sort(np.array([r[0] for r in best], "i8").view("u8"))
    rows = sample.select("text", "label").mapInArrow(_votes(wanted), "label int, votes array<int>").collect()
    v = np.zeros((len(rows), len(wanted) + len(DENSITIES) + 1), bool)
    for i, r in enumerate(rows):
        v[i, r["votes"]] = True
        v[i, -1] = r["label"] == 1
    order = np.lexsort(v.T)  # the sums don't depend on the order in which rows came
    post, _rates, _parent = label_model(v[order], base)
    weights, bias = logistic(v[order][:, :-1].astype("f8"), post)
    return Model(wanted, weights, bias)


def _scorer(model: Model, text: str | None = "text"):
    """Scores of the column `text`, which goes, or with None, of the field text of the column row, which stays."""
    wanted, weights, bias = model.wanted, model.weights, model.bias
    table = lookup(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = np.full(batch.num_rows, bias)
            if len(wanted):
                column = batch.column(text) if text else pc.fill_null(pc.struct_field(batch.column("row"), "text"), "")
                for first, last, has in _present(column, wanted, table):
                    z[first:last] += has @ weights
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != text), pa.array(score)], [*(c for c in batch.schema.names if c != text), "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **limits: int) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **limits)
    out = keyed(docs).select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **limits: int) -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't predicted toxic."""
    model = fit(docs, labels, **limits)
    # the text goes to Python once, inside the row
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return inner.mapInArrow(_scorer(model, None), StructType([*inner.schema, StructField("score", DoubleType())])).where(F.col("score") < threshold).select("row.*")
