"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries share a base of common words. One ends with words typical of toxic text,
the other with as many bytes of ordinary text. A window (a word with the blanks around it,
followed by a fixed tail, since zstandard starts no match in the last bytes of a block) is
toxic evidence if the toxic dictionary makes it shorter, and more so if little but one match
is left of it. How many windows of a document gain how many bytes, and how many of these are
matched as a whole, is turned into a probability by a logistic curve, fitted on the same
bounded sample of labelled rows; so many small gains add up.

Toxic words are found by contrast: all words that occur in many more toxic than ordinary
documents. The size of the dictionaries follows from them.

Defined results: null and empty texts have no window and get the score of no evidence; equal
rows get equal scores; without labels of both classes no window counts as evidence.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import (
    bytes_of, fit_logistic, held_out, labelled_sample, materialized, sigmoid, slices,
)

#: labelled rows that the dictionaries and thresholds are learned from, at most
TRAIN_ROWS = 12_000
#: common words in the base of both dictionaries
COMMON_WORDS = 800
#: toxic documents that a toxic word is in, and how much more often than ordinary ones, at least
LEAST, MIN_LIFT = 3, 20.0
LEVEL = 19
#: words longer than this are seen in windows of this size that overlap by half
WINDOW = 48
PREDICT_FROM = 0.3
#: words whose gain a worker remembers
REMEMBERED = 150_000
#: gains, in bytes, from which windows are counted
STEPS = (3, 4, 5, 6)
#: bytes that stay of a window up to which it counts as matched, and its least gain
MATCHED = ((3, 3), (3, 5), (4, 3), (4, 5), (5, 3))

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_EDGES = b".,!?:;\"'()[]*#$%&|<>-"


def windows(raw: bytes) -> set[bytes]:
    """The distinct windows of a text, lower case, without punctuation at their ends."""
    out = set()
    for word in set(raw.lower().split()):
        word = word.strip(_EDGES)
        if len(word) <= WINDOW:
            out.add(word)
        else:
            out.update(word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2))
    out.discard(b"")
    return out


def _contrast_batches(batches):
    """Document frequencies of words over a task."""
    for batch in slices(batches, 4000):
        ordinary, toxic = Counter(), Counter()
        for raw, y in zip(bytes_of(batch.column("text")), batch.column("y").to_pylist()):
            (toxic if y else ordinary).update(windows(raw))
        keys = list(ordinary.keys() | toxic.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([ordinary[k] for k in keys], pa.int64()),
             pa.array([toxic[k] for k in keys], pa.int64())],
            ["key", "d0", "d1"],
        )


@dataclass
class ToxicityModel:
    """Two dictionaries, the tail of windows, and the logistic curve."""

    toxic: bytes
    ordinary: bytes
    tail: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(STEPS) + len(MATCHED) + 1))
    bias: float = -3.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


# what a Python worker keeps between tasks: the compressors and known gains of a model
_worker: dict = {}


def _compressor(dictionary: bytes):
    log = max(16, (len(dictionary) + 1024).bit_length())
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=3, write_content_size=False, write_checksum=False,
        write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        # tables for dictionary and window, not for the megabytes that the level foresees
        window_log=log, chain_log=log, hash_log=log,
    )
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)


def gains(found: set[bytes], model: ToxicityModel) -> np.ndarray:
    """Per window: bytes that the toxic dictionary saves against the ordinary one, and leaves."""
    if _worker.get("name") != model.name:
        _worker.clear()
        toxic, ordinary = _compressor(model.toxic).compress, _compressor(model.ordinary).compress
        _worker.update(
            name=model.name, known={}, toxic=toxic, ordinary=ordinary,
            tails=(len(toxic(model.tail)), len(ordinary(model.tail))),
        )
    known, toxic, ordinary = _worker["known"], _worker["toxic"], _worker["ordinary"]
    toxic_tail, ordinary_tail = _worker["tails"]
    out = []
    for word in found:
        pair = known.get(word)
        if pair is None:
            window = b" " + word + b" " + model.tail
            left = len(toxic(window)) - toxic_tail
            pair = len(ordinary(window)) - ordinary_tail - left, left
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = pair
        out.append(pair)
    return np.array(out, np.int64).reshape(-1, 2)


def evidence(raw: bytes, model: ToxicityModel) -> np.ndarray:
    """How many windows are matched, how many gain at least each step, how many there are."""
    gain, left = gains(windows(raw) if model.toxic else set(), model).T
    return np.log1p(
        [*(np.count_nonzero((left <= most) & (gain >= least)) for most, least in MATCHED),
         *(np.count_nonzero(gain >= s) for s in STEPS), gain.size]
    ) / ([1.0] * (len(MATCHED) + len(STEPS)) + [3.0])


def _evidence_batches(batches, shared):
    for batch in slices(batches):
        rows = [evidence(raw, shared.value).tolist() for raw in bytes_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), batch.column("y")], ["x", "y"]
        )


def _ending(words: list[bytes]) -> bytes:
    """Words one after the other, the first ones last, where matches cost least."""
    return b" ".join(reversed(words)) + b" "


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled ids that are not held out."""
    sample = materialized(labelled_sample(docs, labels, "toxic", rows), "toxicity-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not (n.get(0) and n.get(1)):
        return ToxicityModel(b"", b"", b"")
    contrast = materialized(
        sample.mapInArrow(_contrast_batches, "key binary, d0 long, d1 long")
        .groupBy("key").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
        .filter((F.col("d0") + F.col("d1")) >= LEAST),
        "toxicity-contrast",
    )
    lift = ((F.col("d1") + 0.5) / (n[1] + 1)) / ((F.col("d0") + 0.5) / (n[0] + 1))
    strings = [
        bytes(r["key"]) for r in contrast.filter((F.col("d1") >= LEAST) & (lift >= MIN_LIFT))
        .orderBy(F.desc("d1"), "key").select("key").collect()
    ]
    if not strings:
        return ToxicityModel(b"", b"", b"")
    toxic_end = b" " + _ending(strings)
    # ordinary words until they are as long as the toxic ones: none has less than a byte
    common = [
        bytes(r["key"]) for r in contrast.filter("d0 > 0").orderBy(F.desc("d0"), "key")
        .select("key").limit(COMMON_WORDS + len(toxic_end)).collect()
    ]
    base = b" " + b" ".join(common[:COMMON_WORDS]) + b" "
    ordinary_end = _ending(common[COMMON_WORDS:] or common or [b"-"])[-len(toxic_end):]
    ordinary_end = ordinary_end.rjust(len(toxic_end))
    model = ToxicityModel(base + toxic_end, base + ordinary_end, base[:48].ljust(24, b"."))
    shared = sample.sparkSession.sparkContext.broadcast(model)  # both dictionaries
    got = sample.mapInArrow(
        partial(_evidence_batches, shared=shared), "x array<double>, y int"
    ).toArrow()
    x, y = np.array(got["x"].to_pylist()), got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums then do not depend on the order of the rows
    model.weights, model.bias = fit_logistic(x[order], y[order], l2=1e-4, steps=3000)
    return model


def score_text(raw: bytes, model: ToxicityModel) -> float:
    return float(sigmoid(np.float64(evidence(raw, model) @ model.weights + model.bias)))


def _score_batches(batches, shared):
    for batch in slices(batches):
        scores = np.array([score_text(raw, shared.value) for raw in bytes_of(batch.column("text"))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held"),
             pa.array(scores, pa.float64()),
             pa.array((scores >= PREDICT_FROM).astype(np.int32), pa.int32())],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """A calibrated score of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(
        "doc_id", "text", held_out(F.col("doc_id")).alias("held")
    ).mapInArrow(partial(_score_batches, shared=shared), SCHEMA)


def _clean_batches(batches, shared):
    for batch in slices(batches):
        keep = [score_text(raw, shared.value) < PREDICT_FROM for raw in bytes_of(batch.column("text"))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_clean_batches, shared=shared), docs.schema)
