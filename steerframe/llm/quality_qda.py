"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a short vector of transformed statistics (logarithms of counts and shares).
Class means and covariances come from sums that tasks pre-aggregate; covariances are shrunk
towards the pooled one and its diagonal. A score is the difference of two Mahalanobis
log-densities, by Cholesky factors that are computed once, passed through a calibrated
logistic curve.

Defined results: a null or empty text has the statistics of no words; equal rows get equal
scores; without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, fit_platt, held_out, labelled_sample, sigmoid, slices
from .text_stats import base_counts

#: labelled rows that the classes are fitted on, at most
TRAIN_ROWS = 20_000
#: weight of the pooled covariance, then of its diagonal
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
PREDICT_FROM = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = b"0123456789"
_POINT = b".,;:!?"


def _share(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole >= part else 0.0


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of one text: logarithms and log-odds of shares."""
    words = raw.split()
    n, chars, symbols, dup_lines, repeats = base_counts(raw, words)
    joined = b"".join(words)
    size = len(joined)
    count = lambda octets: size - len(joined.translate(None, octets))
    upper, letters = count(_UPPER), count(_LETTER)
    lines = raw.count(b"\n") + 1
    return [
        float(np.log1p(n)),
        float(np.log1p(chars / n if n else 0.0)),
        _share(upper, size),
        _share(letters, size),
        _share(count(_DIGIT), size),
        _share(count(_POINT), size),
        _share(symbols, size),
        _share(joined.count(b"!"), size),
        _share(words.count(b"|"), n),
        _share(len(set(words)), n),
        _share(repeats, n),
        _share(dup_lines, lines),
        float(np.log1p(n / lines)),
    ]


WIDTH = len(statistics(b""))


@dataclass(frozen=True)
class ClassDensity:
    """A normal density with the inverse Cholesky factor of its covariance."""

    mean: np.ndarray
    whiten: np.ndarray
    log_norm: float

    @classmethod
    def fit(cls, mean: np.ndarray, cov: np.ndarray, share: float) -> "ClassDensity":
        factor = np.linalg.cholesky(cov)
        return cls(
            mean, np.linalg.inv(factor),
            float(np.log(share) - np.log(np.diag(factor)).sum()),
        )

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.log_norm - 0.5 * (z * z).sum(1)


@dataclass(frozen=True)
class Discriminant:
    good: ClassDensity | None
    bad: ClassDensity | None
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.zeros(len(x))
        gap = self.good.log_density(x) - self.bad.log_density(x)
        return np.sign(gap) * np.log1p(np.abs(gap))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(x) + self.shift)


def _matrix(column) -> np.ndarray:
    return np.array([statistics(raw) for raw in bytes_of(column)]).reshape(-1, WIDTH)


def _moment_batches(batches):
    """Count, sum and sum of outer products of each class over a whole task."""
    sums = {}
    for batch in slices(batches):
        x, y = _matrix(batch.column("text")), batch.column("y").to_numpy(zero_copy_only=False)
        for label in np.unique(y):
            part = x[y == label]
            n, s, q = sums.get(int(label), (0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))))
            sums[int(label)] = (n + len(part), s + part.sum(0), q + part.T @ part)
    for label, (n, s, q) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([label], pa.int32()), pa.array([n], pa.int64()),
             pa.array([s.tolist()], pa.list_(pa.float64())),
             pa.array([q.ravel().tolist()], pa.list_(pa.float64()))],
            ["y", "n", "s", "q"],
        )


def _raw_batches(batches, model):
    for batch in slices(batches):
        gap = model.raw(_matrix(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(gap), batch.column("y")], ["gap", "y"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Discriminant:
    """Fit on at most ``rows`` labelled ids that are not held out."""
    sample = labelled_sample(docs, labels, "quality", rows)
    moments = sample.mapInArrow(
        _moment_batches, "y int, n long, s array<double>, q array<double>"
    )
    by_class = moments.groupBy("y").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)],
        *[F.sum(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(WIDTH * WIDTH)],
    )
    found = {}
    for row in by_class.collect():  # two rows
        n, values = row["n"], list(row)[2:]
        s = np.array(values[:WIDTH])
        q = np.array(values[WIDTH:]).reshape(WIDTH, WIDTH)
        found[row["y"]] = (n, s / n, q / n - np.outer(s / n, s / n))
    if set(found) != {0, 1}:
        return Discriminant(None, None)
    total = found[0][0] + found[1][0]
    pooled = sum(n / total * cov for n, _, cov in found.values())
    base = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    fitted = {
        label: ClassDensity.fit(
            mean, (1 - TO_POOLED) * cov + TO_POOLED * base + 1e-3 * np.eye(WIDTH), n / total
        )
        for label, (n, mean, cov) in found.items()
    }
    model = Discriminant(fitted[1], fitted[0])
    got = sample.mapInArrow(partial(_raw_batches, model=model), "gap double, y int").toArrow()
    gap, y = got["gap"].to_numpy(), got["y"].to_numpy().astype(float)
    order = np.lexsort((gap, y))  # sums then do not depend on the order of the rows
    slope, shift = fit_platt(gap[order], y[order])
    return Discriminant(model.good, model.bad, slope, shift)


def _score_batches(batches, model):
    for batch in slices(batches):
        scores = model.score(_matrix(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held"),
             pa.array(scores), pa.array((scores >= PREDICT_FROM).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """A calibrated score of every document; no shuffle."""
    return docs.select(
        "doc_id", "text", held_out(F.col("doc_id")).alias("held")
    ).mapInArrow(partial(_score_batches, model=model), SCHEMA)
