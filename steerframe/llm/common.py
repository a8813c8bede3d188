"""What the operators of this subpackage share.

Conventions: a null text counts as empty, a null ``doc_id`` is an id of its own that sorts
first, columns that an operator does not name are ignored, and an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steerframe.session import scratch_path

# fixed value: the id that stands for a null doc_id where ids must be compared
NULL_ID = -(2**63)
#: documents that a Python worker holds as objects at a time
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 4) == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, limit: int
) -> DataFrame:
    """(text, y) of at most ``limit`` labelled ids that are not held out.

    The ids are those with the smallest hash, so the choice does not depend on the order of
    the rows. Of contradicting labels of one id the larger holds. Only the list of ids, which
    has ``limit`` rows at most, is broadcast.
    """
    chosen = (
        labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(target).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the mean log loss."""
    n, dim = x.shape
    w, b = np.zeros(dim, x.dtype), 0.0
    if n == 0 or y.min() == y.max():
        share = 0.5 if n == 0 else (y.sum() + 0.5) / (n + 1.0)
        return w, float(np.log(share / (1 - share)))
    # the mean squared row length bounds the curvature
    rate = 4.0 / (float((x.astype(np.float64) ** 2).sum(1).max()) + 1.0)
    pw, pb = w.copy(), b
    for step in range(steps):
        k = step / (step + 3.0)
        vw, vb = w + k * (w - pw), b + k * (b - pb)
        error = sigmoid(x @ vw + vb).astype(x.dtype) - y.astype(x.dtype)
        pw, pb = w, b
        w = vw - rate * (x.T @ error / n + l2 * vw).astype(x.dtype)
        b = vb - rate * float(error.mean())
    return w, float(b)


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities (smoothed targets)."""
    pos, neg = float(y.sum()), float((1 - y).sum())
    if pos == 0 or neg == 0:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(z)) or 1.0
    a, b = 1.0, float(np.log(pos / neg))
    u = (z - z.mean()) / scale
    for _ in range(50):  # Newton steps on two unknowns
        p = sigmoid(a * u + b)
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * u).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum()]])
        move = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-8:
            break
    return a / scale, b - a * float(z.mean()) / scale


def text_key(doc_id: int | None, text: bytes) -> int:
    """A 32-bit number that tells rows of one id but different texts apart."""
    return xxhash.xxh32_intdigest(text, seed=(doc_id or 0) & 0xFFFFFFFF) - 2**31
