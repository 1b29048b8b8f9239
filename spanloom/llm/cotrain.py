"""Quality classifier by co-training a text view and a metadata view.

The text view holds hashed words and bucketed shares of capitals, symbols, long words and repeats; the metadata view holds source,
language and length. Both are logistic models fitted on at most ``labelled`` labelled documents, those with the smallest id
hashes; all others count as unlabelled. In each round either model scores all unlabelled documents, and those of which it is surer than ``sure`` are counted,
feature by feature, as pseudo-labels for the other view; these counts (a table bounded by the number of hashed features) are
the prior around which the other model is fitted again. At the end a held-out fifth of the labels calibrates and combines the
two logits, and every document is scored. Features are made once and read in every round.

Edge cases: null and empty texts have only the shares' features; null source and language are values of their own; a document with
several labels is good only if all are; of rows that share a labelled id the one with the smallest text hash is the sample's;
repeated rows are each scored; without labels of both kinds every document scores 0.5 and stays; an empty table returns no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import text_hash
from .storage import materialize
from .words import U, hash_values, mix, slices, split_words

BITS = 18
LABELLED = 8000
#: Probability beyond which a view's label is passed on, rounds, and the weight of the prior that pseudo-labels make.
SURE, ROUNDS, PRIOR = 0.95, 2, 0.25
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>!=@^~_"])
CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def _bucket(name: str, value: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"\x00{name}{int(v)}") & ((1 << BITS) - 1) for v in value], np.int64)


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct feature indexes of each text."""
    n = len(texts)
    offsets, flat = split_words(texts)
    words = (mix(hash_values(flat)) >> U(64 - BITS)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    size = np.maximum(np.diff(ends), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data])])[ends]) / size
    cell = np.unique(owner << BITS | words)
    count = np.maximum(np.diff(offsets), 1)
    distinct = np.bincount(cell >> BITS, minlength=n) / count
    extra = [
        _bucket("caps", np.ceil(20 * share(CAPITALS))), _bucket("symbols", np.ceil(50 * share(SYMBOLS))),
        _bucket("mean", np.minimum(size / count, 20)), _bucket("distinct", 10 * distinct),
    ]
    cell = np.unique(np.concatenate([cell, *(np.arange(n) << BITS | e for e in extra)]))
    return np.searchsorted(cell >> BITS, np.arange(n + 1)), cell & ((1 << BITS) - 1)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three feature indexes of each row."""
    one = lambda s: xxhash.xxh3_64_intdigest(s) & ((1 << BITS) - 1)
    return np.array([[one(f"s{a}"), one(f"l{b}"), one(f"n{int(c or 0).bit_length()}")] for a, b, c in zip(source, lang, n_chars, strict=True)], np.int64).reshape(-1, 3)


class Logistic:
    """Sparse logistic regression on sets of features, fitted by AdaGrad with weight decay."""

    def __init__(self):
        self.w, self.b = np.zeros(1 << BITS, np.float32), 0.0

    def logits(self, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.w[index], dtype=np.float64)])
        n = np.maximum(np.diff(offsets), 1)
        return self.b + (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(n) * 4

    def fit(self, offsets: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray | None = None, steps: int = 150, decay: float = 1e-4) -> Logistic:
        """Fit from the start; weights decay towards ``prior``."""
        prior = np.zeros(len(self.w), np.float32) if prior is None else prior
        self.w, self.b = prior.copy(), 0.0
        n = np.maximum(np.diff(offsets), 1)
        owner = np.repeat(np.arange(len(n)), np.diff(offsets))
        scale = 4 / np.sqrt(n)
        seen, gb = np.full(len(self.w), 1e-8), 1e-8
        for _ in range(steps):
            err = weight * (1 / (1 + np.exp(-np.clip(self.logits(offsets, index), -30, 30))) - y) / weight.sum()
            grad = np.bincount(index, (err * scale)[owner], len(self.w)) + decay * (self.w - prior) / 100
            seen += grad * grad
            self.w -= (0.3 * grad / np.sqrt(seen)).astype(np.float32)
            gb += err.sum() ** 2
            self.b -= 0.3 * err.sum() / np.sqrt(gb)
        return self


def prior_of(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Prior weights from the pseudo-labelled documents that hold each feature: shrunken log odds against the mean."""
    base = math.log((good.sum() + 1) / (bad.sum() + 1))
    odds = np.log((good + 1) / (bad + 1)) - base
    return (PRIOR * np.clip(odds, -3, 3) * (good + bad) / (good + bad + 10)).astype(np.float32)


class Model:
    def __init__(self):
        self.text, self.meta, self.mix = Logistic(), Logistic(), np.zeros(3)

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Calibrated probability from the two views' logits."""
        return 1 / (1 + np.exp(-np.clip(self.mix[0] + self.mix[1] * a + self.mix[2] * b, -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(views: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, held: np.ndarray, exchange: Callable[[Model], list[tuple[np.ndarray, np.ndarray]]], rounds: int = ROUNDS) -> Model:
    """Co-train on labelled rows; ``held`` rows only calibrate.

    ``exchange`` gives, for a model, the (good, bad) counts by feature of what the other view is sure of: for the text view, then for metadata.
    """
    model = Model()
    own = ~held
    if not (y[own] == 1).any() or not (y[own] == 0).any():
        return model
    models = [model.text, model.meta]
    good = y[own].astype(float)
    weight = np.where(good > 0.5, 0.5 / good.mean(), 0.5 / (1 - good.mean()))  # classes weigh alike

    def part(view: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets, index = view
        size = np.diff(offsets)
        return np.concatenate([[0], np.cumsum(size[rows])]), index[np.repeat(rows, size)]

    mine = [part(v, own) for v in views]
    priors: list[np.ndarray | None] = [None, None]
    for r in range(rounds + 1):
        for m, v, prior in zip(models, mine, priors, strict=True):
            m.fit(*v, good, weight, prior)
        if r < rounds:
            priors = [prior_of(*counts) for counts in exchange(model)]
    rest = [part(v, held) for v in views]
    x = np.stack([np.ones(held.sum()), *(m.logits(*v) for m, v in zip(models, rest, strict=True))], 1)
    w = np.array([0.0, 1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        hess = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(3)
        w = w - np.linalg.solve(hess, x.T @ (p - y[held]) + 1e-2 * (w - [0, 1, 0]))
    model.mix = w
    return model


COLUMNS = ["text", "source", "lang", "n_chars"]
FEATURES = "doc_id long, text_hash long, words array<int>, meta array<int>"


def _lists(offsets: np.ndarray, index: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(index.astype(np.int32)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        c = {n: b.column(b.schema.get_field_index(n)) for n in ["doc_id", "text_hash", *COLUMNS]}
        meta = meta_view(c["source"].to_pylist(), c["lang"].to_pylist(), c["n_chars"].to_pylist())
        cols = [c["doc_id"], c["text_hash"], _lists(*text_view(c["text"])), _lists(np.arange(len(meta) + 1) * 3, meta.ravel())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "words", "meta"])


def _ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)


def _logits(model: Model, b: pa.RecordBatch) -> list[np.ndarray]:
    return [m.logits(*_ragged(b.column(b.schema.get_field_index(c)))) for m, c in ((model.text, "words"), (model.meta, "meta"))]


def _sure(model: Model, sure: float) -> Callable:
    """Per view and feature, the documents that the other view is sure are good or bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 1 << BITS))  # view, bad or good, feature
        for b in batches:
            logits = _logits(model, b)
            for v, (c, p) in enumerate(zip(("words", "meta"), (sigmoid(logits[1]), sigmoid(logits[0])), strict=True)):
                offsets, index = _ragged(b.column(b.schema.get_field_index(c)))
                owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                for g, mask in enumerate((p < 1 - sure, p > sure)):
                    total[v, g] += np.bincount(index[mask[owner]], minlength=1 << BITS)
        for v in (0, 1):
            at = np.flatnonzero(total[v].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)), pa.array(at), pa.array(total[v, 1, at]), pa.array(total[v, 0, at])], names=["v", "feature", "good", "bad"])

    return run


def learn(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, sure: float = SURE, rounds: int = ROUNDS) -> Model:
    """Fit on ``features`` (``FEATURES``); ``labels`` has doc_id and good (boolean)."""
    y = labels.groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("y")).where("y is not null")
    some = materialize(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labelled")  # a bounded broadcast, and a bounded gathering of their features
    sample = features.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("y", "words", "meta"), "text_hash").alias("r"))
    got = sample.select("doc_id", "r.*").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return Model()
    held = np.array([xxhash.xxh3_64_intdigest(str(i)) % 5 == 0 for i in got["doc_id"].to_pylist()], bool)
    free = features.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select("words", "meta")

    def exchange(model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
        out = np.zeros((2, 2, 1 << BITS))
        sums = free.mapInArrow(_sure(model, sure), "v long, feature long, good double, bad double").groupBy("v", "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        counts = sums.toArrow()  # at most two rows a feature
        v, at = counts["v"].to_numpy(), counts["feature"].to_numpy()
        out[v, 0, at], out[v, 1, at] = counts["good"].to_numpy(), counts["bad"].to_numpy()
        return [(out[v, 0], out[v, 1]) for v in (0, 1)]

    return train([_ragged(got[c].combine_chunks()) for c in ("words", "meta")], got["y"].to_numpy(), held, exchange, rounds)


def _scores(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m = _logits(model, b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a), pa.array(m), pa.array(model.score(a, m))], names=["doc_id", "text_logit", "meta_logit", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **options) -> DataFrame:
    """doc_id, text_logit, meta_logit, score (probability of good) and keep of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), *COLUMNS)
    features = materialize(rows.mapInArrow(_features, FEATURES), "features")
    model = learn(features, labels, **options)
    scored = features.select("doc_id", "words", "meta").mapInArrow(_scores(model), "doc_id long, text_logit double, meta_logit double, score double")
    return scored.withColumn("keep", F.col("score") >= cut)
