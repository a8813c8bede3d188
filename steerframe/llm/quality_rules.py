"""Quality rules: fixed rules, then a hashed n-gram logistic regression.

Word one- and two-grams and byte four-grams are hashed into fixed tables; a document is the
square root of its shares, so its length does not matter. A logistic regression is trained on
a bounded sample of labelled rows, and its scores are turned into probabilities on a fold of
the sample that it has not seen (Platt). Documents are scored in Arrow batches against a fixed
threshold.

Defined results: null and empty texts have no words and fail the base rules; equal rows get
equal results; without labels of both classes the model passes every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, fit_logistic, fit_platt, labelled_sample, sigmoid, slices
from .text_stats import base_counts

BITS = 11
DIM = 1 << BITS
#: labelled rows that the model is trained on, at most
TRAIN_ROWS = 4000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean, quality double"
)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: bytes, words: list[bytes]) -> float:
        z = float(features(raw, words) @ self.weights) + self.bias
        return float(sigmoid(np.float64(self.slope * z + self.shift)))


def features(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed word grams, then of hashed byte four-grams."""
    out = np.zeros(2 * DIM, np.float32)
    if words:
        ones = np.fromiter(map(crc32, words), np.uint32, len(words))
        pairs = ones[1:] ^ (ones[:-1] * np.uint32(0x85EBCA6B))
        grams = np.concatenate([ones, pairs]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        out[:DIM] = np.sqrt(np.bincount(grams, minlength=DIM) / len(grams))
    octets = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(octets) >= 4:
        grams = octets[:-3] | octets[1:-2] << 8 | octets[2:-1] << 16 | octets[3:] << 24
        grams = grams * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        out[DIM:] = np.sqrt(np.bincount(grams, minlength=DIM) / len(grams))
    return out


def _feature_batches(batches):
    for batch in slices(batches, 200):
        rows = [features(raw, raw.split()) for raw in bytes_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("y")], ["x", "y"]
        )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled ids that are not held out (16 kB each)."""
    sample = labelled_sample(docs, labels, "quality", rows)
    got = sample.mapInArrow(_feature_batches, "x binary, y int").toArrow()
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(2 * DIM, np.float32), 20.0, 1.0, 0.0)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), 2 * DIM)
    # rows come in any order: the fold depends on what a row holds
    fold = np.array([crc32(row) % 5 == 0 for row in got["x"].to_pylist()])
    order = np.lexsort((x[:, :8].sum(1), y))
    x, y, fold = x[order], y[order], fold[order]
    if y[fold].sum() < 3 or (1 - y[fold]).sum() < 3:
        fold = np.zeros(len(y), bool)
    weights, bias = fit_logistic(x[~fold], y[~fold], l2=1e-5, steps=400)
    seen = fold if fold.any() else ~fold
    slope, shift = fit_platt((x[seen] @ weights).astype(np.float64) + bias, y[seen])
    return QualityModel(weights, bias, slope, shift)


def _judged(raw: bytes, model: QualityModel):
    words = raw.split()
    counts = base_counts(raw, words)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    quality = model.probability(raw, words)
    return (*counts, failed, not failed and quality >= KEEP_FROM, quality)


def _score_batches(batches, shared):
    model = shared.value
    for batch in slices(batches):
        rows = [_judged(raw, model) for raw in bytes_of(batch.column("text"))]
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64())]
            + [pa.array(c, k) for c, k in zip(columns, kinds)],
            [part.split()[0] for part in SCHEMA.split(", ")],
        )


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Counts, rules and verdict of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 kB
    return docs.select("doc_id", "text").mapInArrow(
        partial(_score_batches, shared=shared), SCHEMA
    )


def _kept_batches(batches, shared):
    model = shared.value
    for batch in slices(batches):
        kept = [_judged(raw, model)[6] for raw in bytes_of(batch.column("text"))]
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_kept_batches, shared=shared), docs.schema)
