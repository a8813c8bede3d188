"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

Each document becomes its tokens and one closing id; only documents longer than a sequence are
cut. Pieces are dealt by a hash into groups of bounded size. In a group they are taken from
the longest to the shortest, and each goes to the open sequence with the least room that still
holds it; a segment tree over room sizes finds it in logarithmic time. A group leaves a few
sequences part empty, one in some thousand.

Defined results: a null or empty text is the closing id alone; equal rows are packed one by
one; ties go by id, piece and content; an empty table packs to no rows.
"""

from __future__ import annotations

import os
from functools import partial
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, slices

SEQUENCE = 2048
END_ID = 0
#: documents of which the last pieces share a group, on average
GROUP_DOCS = 16_384
#: words whose ids a Python worker remembers
REMEMBERED = 700_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = PIECES + ", sequence_id long, offset long"

# fixed value: marks that the tokenizer never joins with a letter or digit before them
MARKS = b".,;:!?#*$%&|<>()[]{}+=/\\-_~\"@^`"

# what a Python worker keeps between tasks: tokenizer and known words by vocabulary path
_worker: dict = {}


def _words_of(path: str):
    if path not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker[path] = (Tokenizer.from_file(path), {})
    return _worker[path]


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word as two parts that the tokenizer encodes apart, so that more words share them.

    It lowers all letters and splits between a letter or digit and the marks behind it; only
    the strings of special tokens must stay whole.
    """
    if b"<|" in word:
        return word, b""
    core = word.rstrip(MARKS).lower()
    return (core, word[len(core) :]) if core[-1:].isalnum() else (word, b"")


def token_bytes(raw: bytes, path: str) -> bytes:
    """Ids of a text as little-endian 32-bit numbers.

    The vocabulary drops white space before it looks at words, so words between blanks can be
    encoded one by one, and each different word only once.
    """
    tokenizer, known = _words_of(path)
    words = raw.split()
    found = list(map(known.get, words))
    if None in found:
        missing = {w for w, ids in zip(words, found) if ids is None}
        parts = {w: _parts(w) for w in missing}
        asked = list({p for pair in parts.values() for p in pair if p and p not in known})
        if len(known) + len(missing) + len(asked) > REMEMBERED:
            known.clear()
            asked = list({p for pair in parts.values() for p in pair if p})
        encoded = tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in asked], add_special_tokens=False
        )
        for word, e in zip(asked, encoded):
            known[word] = np.array(e.ids, np.uint32).tobytes()
        fresh = {w: known[core] + known.get(tail, b"") for w, (core, tail) in parts.items()}
        known.update(fresh)
        found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
    return b"".join(found)


def _piece_batches(batches, path, sequence):
    step, end = 4 * sequence, END_ID.to_bytes(4, "little")
    names = [part.split()[0] for part in PIECES.split(", ")]
    for batch in slices(batches):
        rows = []
        ids = batch.column("doc_id").to_pylist()
        for doc_id, raw in zip(ids, bytes_of(batch.column("text"))):
            data = token_bytes(raw, path) + end
            for piece, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                rows.append((doc_id, piece, at // 4, len(part) // 4, crc32(part)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names
        )


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of every document with their lengths and checksums; no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_piece_batches, path=path, sequence=sequence), PIECES
    )


class RoomTree:
    """How many open sequences have each amount of room, as a segment tree of sums."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.sums = [0] * (2 * self.size)

    def change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.sums[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that some sequence has."""
        node, sums = need + self.size, self.sums
        if sums[node]:
            return need
        # up to the first right neighbour that holds something, then down to its left edge
        while node > 1 and (node & 1 or not sums[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if sums[2 * node] else 2 * node + 1
        return node - self.size


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths must come in falling order."""
    tree, open_bins = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for length in lengths.tolist():
        room = tree.tightest(length)
        if room is None:
            place, room, made = made, capacity, made + 1
        else:
            place = open_bins[room].pop()
            tree.change(room, -1)
        bins.append(place)
        offsets.append(capacity - room)
        if room > length:
            open_bins[room - length].append(place)
            tree.change(room - length, 1)
    return bins, offsets


def _pack_group(key, rows: pa.Table, sequence: int) -> pa.Table:
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
             ("ids_crc32", "ascending")]
    rows = rows.sort_by(order)
    bins, offsets = best_fit(rows.column("length").to_numpy(), sequence)
    first = key[0].as_py() << 32
    return rows.drop_columns(["packing_group"]).append_column(
        "sequence_id", pa.array([first + b for b in bins], pa.int64())
    ).append_column("offset", pa.array(offsets, pa.int64()))


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Every piece with its sequence and its place there."""
    groups = max(1, ceil(docs.count() / GROUP_DOCS))
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))

    def packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _pack_group(key, rows, sequence)

    return (
        pieces(docs, path, sequence)
        .withColumn("packing_group", group)
        .groupBy("packing_group")
        .applyInArrow(packed, SCHEMA)
    )
