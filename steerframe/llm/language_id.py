"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, every run of characters that are no letters becomes one space, and its
character one- to four-grams are hashed into ``DIM`` buckets. A bucket weighs
(1 + log count) times its inverse document frequency, and a document has length one. Document
frequencies are counted over all training documents, in every partition before the shuffle.
The weights are learned by follow-the-regularised-leader with an elastic-net penalty on at most
``TRAIN_ROWS`` training documents, an equal share for each language, and a temperature is fitted
on the fold of that sample that the weights have not seen.

Defined results: a text that is null, empty or has no letter is ``und`` with score 0; equal texts
get equal results; a null ``doc_id`` is a training document; without training documents every
text is ``und``; of equal probabilities the first language in alphabetical order holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_remainder, slices

BITS = 15
DIM = 1 << BITS
LONGEST_GRAM = 4
#: training documents that the weights are learned from, at most
TRAIN_ROWS = 4000
UNKNOWN = "und"
#: languages whose rows are thinned out before they are ranked, at most
HOT_LANGS = 1000

# learning rate, its damping, and the two penalties
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
EPOCHS = 3

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` holds one column per language for each bucket with a weight."""

    langs: list[str]
    idf: np.ndarray
    place: np.ndarray  # row of ``weights`` for each bucket, the last row (zeros) for none
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, counts = grams(text)
        if not len(buckets) or not self.langs:
            return UNKNOWN, 0.0
        x = weighted(buckets, counts, self.idf)
        p = softmax((x @ self.weights[self.place[buckets]] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, ascending, and how often each occurs."""
    nothing = np.zeros(0, np.int64)
    if not text:
        return nothing, nothing
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return nothing, nothing
    points = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.uint32)
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))]
    counts = np.bincount(_bucket(points[points != 32], 1), minlength=DIM)
    rolling = points
    for n in range(2, LONGEST_GRAM + 1):
        if len(points) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
        counts += np.bincount(_bucket(rolling, n), minlength=DIM)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    mixed = (values + np.uint32(n)) * np.uint32(0x9E3779B1)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def weighted(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a document, as a vector of length one."""
    x = (1.0 + np.log(counts)) * idf[buckets]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequency_batches(batches):
    """Documents that hold each bucket, one row per bucket and partition; -1 counts documents."""
    holding, docs = np.zeros(DIM, np.int64), 0
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            buckets, _ = grams(text)
            holding[buckets] += 1
            docs += len(buckets) > 0
    seen = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(seen, -1)), pa.array(np.append(holding[seen], docs))], ["bucket", "n"]
    )


def inverse_frequencies(training: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + holding)) + 1 for each bucket, over all training documents."""
    counted = (
        training.select("text").mapInArrow(_frequency_batches, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # DIM + 1 rows at most
    )
    buckets, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    docs = int(n[buckets == -1].sum())
    holding = np.zeros(DIM)
    holding[buckets[buckets >= 0]] = n[buckets >= 0]
    return np.log((1.0 + docs) / (1.0 + holding)) + 1.0


def _near_share(training: DataFrame, per_lang: int) -> Column:
    """Whether a document's hash is in the share of its language that holds ``per_lang`` for sure.

    That share is four times what is wanted; a language with fewer documents, or one not among
    the ``HOT_LANGS`` most frequent, is taken whole. So no language sends all its rows to one
    task, and only ``HOT_LANGS`` short rows come to the driver.
    """
    counts = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") > 4 * per_lang).orderBy(F.desc("n"), "lang").limit(HOT_LANGS)
    shares = {row.lang: 4 * per_lang / row.n for row in hot.collect()}
    if not shares:
        return F.lit(True)
    listed = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    place = (F.col("_hash") / F.lit(2.0**64)) + 0.5
    return place <= F.coalesce(F.try_element_at(listed, F.col("lang")), F.lit(1.0))


def training_sample(training: DataFrame, rows: int) -> DataFrame:
    """(text, lang) of at most ``rows`` documents, an equal share of each language.

    Those with the smallest hash are taken, so the order of the rows does not matter.
    """
    per_lang = max(1, rows // max(1, training.agg(F.count_distinct("lang")).first()[0]))
    smallest = Window.partitionBy("lang").orderBy("_hash", "doc_id", "_text_hash")
    chosen = (
        training.select(
            "doc_id", "lang", F.xxhash64("doc_id").alias("_hash"),
            F.xxhash64("text").alias("_text_hash"),
        )
        .filter(_near_share(training, per_lang))
        .withColumn("_rank", F.row_number().over(smallest))
        .filter(F.col("_rank") <= per_lang)
        .orderBy("_rank", "lang").limit(rows)
        .select("doc_id", "lang", "_text_hash").distinct()
    )
    same = [
        F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "lang")
    ] + [F.xxhash64("t.text") == F.col("c._text_hash")]
    # at most ``rows`` short rows
    picked = training.alias("t").join(F.broadcast(chosen.alias("c")), same, "left_semi")
    # equal rows are one document here
    return picked.groupBy("doc_id", "lang", F.xxhash64("text")).agg(
        F.first("text").alias("text")
    ).select("text", "lang")


def _feature_batches(batches):
    for batch in slices(batches, 200):
        pairs = [grams(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b.astype(np.int32).tobytes() for b, _ in pairs], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, c in pairs], pa.binary()),
                batch.column("lang"),
            ],
            ["buckets", "counts", "lang"],
        )


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]], classes: list[int], n_classes: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket by class) and biases, learned document by document.

    Each coordinate keeps the sum of its adjusted gradients and of their squares; its weight is
    the leader of all past losses under the elastic-net penalty, zero while that sum is within
    the L1 penalty.
    """
    total, squares = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))
    l1 = np.full((DIM + 1, 1), L1 * len(rows))
    l1[DIM] = 0.0  # the bias is not penalised

    def leader(at):
        z, n = total[at], squares[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1[at], 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2 * len(rows))

    for _ in range(EPOCHS):
        for (buckets, x), k in zip(rows, classes):
            at, value = np.append(buckets, DIM), np.append(x, 1.0)
            w = leader(at)
            error = softmax(value @ w)
            error[k] -= 1.0
            gradient = value[:, None] * error
            after = squares[at] + gradient**2
            total[at] += gradient - (np.sqrt(after) - np.sqrt(squares[at])) / ALPHA * w
            squares[at] = after
    learned = leader(np.arange(DIM + 1))
    return learned[:DIM], learned[DIM]


def fit_temperature(z: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search."""
    if not len(z):
        return 1.0
    rows = np.arange(len(z))

    def loss(log_t: float) -> float:
        return -float(np.log(softmax(z / np.exp(log_t))[rows, classes] + 1e-12).mean())

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on the documents that are not held out and have a language."""
    training = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        "doc_id", "text", "lang"
    )
    idf = inverse_frequencies(training)
    got = (
        training_sample(training, rows)
        .mapInArrow(_feature_batches, "buckets binary, counts binary, lang string")
        .toArrow()
    )
    # rows come in any order: theirs here follows from what they hold
    examples = sorted(
        (crc32(b + c), b, c, lang)
        for b, c, lang in zip(*(got[k].to_pylist() for k in ("buckets", "counts", "lang")))
        if b
    )
    langs = sorted({lang for *_, lang in examples})
    if not langs:
        return LanguageModel([], idf, np.zeros(DIM, np.int32), np.zeros((1, 0)), np.zeros(0), 1.0)
    vectors, classes, kept_out = [], [], []
    for digest, b, c, lang in examples:
        buckets = np.frombuffer(b, np.int32)
        vectors.append((buckets, weighted(buckets, np.frombuffer(c, np.int32), idf)))
        classes.append(langs.index(lang))
        kept_out.append(digest % 5 == 0)
    fit = [i for i, out in enumerate(kept_out) if not out] or list(range(len(vectors)))
    weights, bias = follow_the_leader(
        [vectors[i] for i in fit], [classes[i] for i in fit], len(langs)
    )
    unseen = [i for i, out in enumerate(kept_out) if out]
    z = np.array([vectors[i][1] @ weights[vectors[i][0]] + bias for i in unseen])
    temperature = fit_temperature(z, np.array([classes[i] for i in unseen], np.int64))
    used = np.flatnonzero(weights.any(axis=1))
    place = np.full(DIM, len(used), np.int32)
    place[used] = np.arange(len(used))
    compact = np.vstack([weights[used], np.zeros((1, len(langs)))])
    return LanguageModel(langs, idf, place, compact, bias, temperature)


def _predicted_batches(batches, shared):
    model = shared.value
    for batch in slices(batches):
        found = [model.predict(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("held_out"),
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The most probable language of every document and its probability; no shuffle.

    The model that is broadcast has at most ``DIM`` rows of one number per language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        partial(_predicted_batches, shared=shared), SCHEMA
    )
