"""Removal of repeated passages by prefix doubling over sampled suffixes.

A byte is removed if it lies in a ``threshold``-byte string that also starts earlier. Ranks are
names of prefixes: the name of length 2k at a position is made of the names of length k there
and k further on, so names of length 1, 2, 4, .. follow from each other at growing offsets.
Positions of one name are equal that far, and a position whose name no other position has
needs no longer name.

Not every position is sorted. Every string of ``threshold`` bytes holds the same sampled
position wherever it occurs: the leftmost least name of 24 bytes in it. Consecutive strings
mostly share theirs, so one position in some forty stands for a run of strings:

1. Sampled positions are sorted by (name, name of the whole run, position). A name that no
   other run has ends there. Of runs equal as a whole, all but the first are repeats.
2. First runs whose name other runs share, that is the ends of repeats, are opened: each of
   their strings gets its name of ``threshold`` bytes, and all but the first of each are
   repeats. Runs meet by the name of their sampled position, some thousand names to a task;
   the strings of a name with very many runs are sorted by Spark one by one.

Before a sort a task keeps only the first of its equal runs or strings, so a passage that
most documents hold reaches the sort once for each batch, not for each document.

Defined results: a null text is empty; a null id sorts first; documents with the same id are
ordered by a hash of their text, and rows equal in both are one document whose result each
row gets; texts shorter than the threshold keep all.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import NULL_ID, bytes_of, materialized, slices, text_key

THRESHOLD = 100
NAMED = 24
#: documents in which a task looks for equal runs at once
BATCH = 2000
#: opened runs that meet in a task, on average, and runs of one name that may meet there
GROUP_RUNS, CROWD = 20_000, 20_000

KEY = "id long not null, part int not null"
RUNS = KEY + ", lo int, hi int, place long not null, whole long"
OPENED = KEY + ", lo int, hi int, place long not null, crowd long, octets binary"
SPANS = "id long, part int, lo int, hi int"
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_OCTET = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (
    np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) >> np.uint64(23)
)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ROOT), n, 2**64))


def names(octets: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` bytes, by doubling."""
    n = len(octets) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, done, out = _OCTET[octets], 1, 0, None
    while True:
        if length & size:  # put the name of this length behind what is named so far
            piece = level[done : done + n]
            out = piece if out is None else out[:n] * _power(size) + piece
            done += size
        if 2 * size > length:
            return out[:n]
        level = level[:-size] * _power(size) + level[size:]
        size *= 2


def sampled_runs(octets: np.ndarray, threshold: int, named: int) -> tuple[np.ndarray, ...]:
    """First and last string of each run, and the name at its sampled position."""
    label = names(octets, named)
    # spread the order, else frequent letters would be sampled more
    value = (label ^ (label >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    width = threshold - named + 1
    place = np.arange(len(value), dtype=np.int32)
    done = 1
    while done < width:
        step = min(done, width - done)
        first = value[:-step] <= value[step:]
        place = np.where(first, place[:-step], place[step:])
        value = np.minimum(value[:-step], value[step:])
        done += step
    cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
    lo = np.concatenate([[0], cuts])
    hi = np.concatenate([cuts - 1, [len(place) - 1]])
    return lo, hi, label[place[lo]]


def _document_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.sort_by([("id", "ascending"), ("part", "ascending")])


def _first_of_equal(keys: np.ndarray) -> np.ndarray:
    """For rows in document order: which are the first with their pair of keys."""
    order = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (ordered[1:] != ordered[:-1]).any(1)
    out = np.zeros(len(keys), bool)
    out[order[first]] = True
    return out


def _key_batches(batches, pack):
    """id, part and text; compressed if it is to be shuffled."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        texts = bytes_of(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pc.fill_null(batch.column("doc_id").cast(pa.int64()), NULL_ID),
             pa.array([text_key(i, t) for i, t in zip(ids, texts)], pa.int32()),
             pa.array([squeeze(t) for t in texts] if pack else texts, pa.binary())],
            ["id", "part", "text"],
        )


def _rows(parts: list[list], columns: list[str], kinds: list) -> pa.RecordBatch:
    arrays = [
        pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)).cast(k)
        for p, k in zip(parts, kinds)
    ]
    return pa.RecordBatch.from_arrays(arrays, columns)


_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _run_batches(batches, threshold, named):
    for batch in slices(_key_batches(batches, False), BATCH):
        batch = _document_order(batch)
        parts: list[list] = [[] for _ in range(6)]
        last = None
        for i, p, raw in zip(
            batch.column("id").to_pylist(), batch.column("part").to_pylist(),
            batch.column("text").to_pylist(),
        ):
            if len(raw) < threshold or (i, p) == last:  # equal rows are one document
                continue
            last = i, p
            lo, hi, label = sampled_runs(np.frombuffer(raw, np.uint8), threshold, named)
            whole = np.array(
                [xxhash.xxh3_64_intdigest(raw[a : b + threshold])
                 for a, b in zip(lo.tolist(), hi.tolist())], np.uint64,
            )
            n = len(lo)
            for part, column in zip(
                parts,
                (np.full(n, i), np.full(n, p), lo, hi, label.view(np.int64), whole.view(np.int64)),
            ):
                part.append(column)
        rows = _rows(parts, ["id", "part", "lo", "hi", "place", "whole"], _KINDS)
        yield from _marked(rows)


def _marked(rows: pa.RecordBatch):
    """First rows as they are; the rest, joined where they touch, settled and so without name.

    Settled rows go to any task, so their place is a number of their own.
    """
    place, whole = rows.column("place").to_numpy(), rows.column("whole").to_numpy()
    first = _first_of_equal(np.stack([place, whole], 1))
    yield rows.filter(pa.array(first))
    i, p, lo, hi = _joined(*(rows.column(c).to_numpy()[~first] for c in ("id", "part", "lo", "hi")))
    spread = (i.view(np.uint64) * _ROOT + lo.astype(np.uint64) * _OCTET[7]).view(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i), pa.array(p), pa.array(lo), pa.array(hi), pa.array(spread),
         pa.nulls(len(i), pa.int64())], rows.schema.names,
    )


def _joined(i, p, lo, hi) -> tuple[np.ndarray, ...]:
    """Rows in document order, those that touch as one."""
    if not len(i):
        return i, p, lo, hi
    apart = (i[1:] != i[:-1]) | (p[1:] != p[:-1]) | (lo[1:] != hi[:-1] + 1)
    start, end = np.concatenate([[True], apart]), np.concatenate([apart, [True]])
    return i[start], p[start], lo[start], hi[end]


def _opened_batches(batches, threshold):
    """The opened runs of each document with the bytes of their strings."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, BATCH):
        rows = []
        for i, p, packed, runs in zip(
            batch.column("id").to_pylist(), batch.column("part").to_pylist(),
            batch.column("text").to_pylist(), batch.column("opened").to_pylist(),
        ):
            raw = unpack(packed)
            rows += [
                (i, p, r["lo"], r["hi"], r["place"], r["crowd"], raw[r["lo"] : r["hi"] + threshold])
                for r in runs
            ]
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["id", "part", "lo", "hi", "place", "crowd", "octets"],
        )


def _strings(rows, threshold: int) -> tuple[np.ndarray, ...]:
    """id, part, start, place and name of every string of runs, in document order."""
    rows = rows.sort_by([("id", "ascending"), ("part", "ascending"), ("lo", "ascending")])
    i, p, lo, hi, place = (rows.column(c).to_numpy() for c in ("id", "part", "lo", "hi", "place"))
    joined = b"".join(rows.column("octets").to_pylist())
    label = names(np.frombuffer(joined, np.uint8), threshold)
    n = hi.astype(np.int64) - lo + 1
    # the strings of a run start at its first n bytes
    begin = np.cumsum(n + threshold - 1) - (n + threshold - 1)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(lo, n) + step.astype(np.int32)
    return (
        np.repeat(i, n), np.repeat(p, n), at, np.repeat(place, n),
        label[np.repeat(begin, n) + step].view(np.int64),
    )


def _settle_group(rows: pa.Table, threshold: int) -> pa.Table:
    """All but the first of equal strings of the names that meet here."""
    i, p, at, place, label = _strings(rows, threshold)
    again = ~_first_of_equal(np.stack([place, label], 1))
    i, p, lo, hi = _joined(i[again], p[again], at[again], at[again])
    return pa.table({"id": i, "part": p, "lo": lo, "hi": hi})


def _string_batches(batches, threshold):
    for batch in slices(batches, 5000):
        i, p, at, place, label = _strings(batch, threshold)
        yield from _marked(pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (i, p, at, at, place, label)],
            ["id", "part", "lo", "hi", "place", "whole"],
        ))


def _collected(rows: DataFrame, label: str, *columns: str) -> DataFrame:
    """One row per document with its runs in order; a document bounds its runs."""
    return rows.groupBy("id", "part").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi", *columns))).alias(label)
    )


def repeated_runs(
    docs: DataFrame, packed: DataFrame, threshold: int = THRESHOLD
) -> DataFrame:
    """(id, part, runs) of documents with repeats: runs of starts of strings seen earlier."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_run_batches, threshold=threshold, named=min(NAMED, threshold)), RUNS
    )
    by_name = Window.partitionBy("place")
    # equal rows from different batches have equal runs, which share a rank
    in_order = Window.partitionBy("place", "whole").orderBy("id", "part", "lo")
    same = F.rank().over(in_order) > 1
    judged = materialized(
        runs.select(
            "id", "part", "lo", "hi", "place",
            (F.col("whole").isNull() | same).alias("repeat"),
            (F.min("whole").over(by_name) < F.max("whole").over(by_name)).alias("shared"),
            F.count(F.lit(1)).over(by_name).alias("crowd"),
        ).filter("repeat OR shared").drop("shared"),
        "suffix-runs",
    )
    opened = _collected(judged.filter("NOT repeat"), "opened", "place", "crowd")
    opened = materialized(
        packed.join(opened, ["id", "part"]).dropDuplicates(["id", "part"])
        .mapInArrow(partial(_opened_batches, threshold=threshold), OPENED),
        "suffix-opened",
    )

    def settled(rows: pa.Table) -> pa.Table:
        return _settle_group(rows, threshold)

    groups = max(1, opened.count() // GROUP_RUNS)
    again = (
        opened.filter(F.col("crowd") <= CROWD)
        .groupBy(F.pmod(F.xxhash64("place"), F.lit(groups)).alias("name_group"))
        .applyInArrow(settled, SPANS)
    )
    crowded = (
        opened.filter(F.col("crowd") > CROWD)
        .mapInArrow(partial(_string_batches, threshold=threshold), RUNS)
        .select(
            "id", "part", "lo", "hi", "whole",
            F.row_number().over(
                Window.partitionBy("place", "whole").orderBy("id", "part", "lo")
            ).alias("nth"),
        )
        .filter("whole IS NULL OR nth > 1").select("id", "part", "lo", "hi")
    )
    found = judged.filter("repeat").select("id", "part", "lo", "hi")
    return _collected(found.unionByName(again).unionByName(crowded), "runs")


def packed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_key_batches, pack=True), KEY + ", text binary"
    )


def _kept(raw: bytes, runs: list[dict] | None, threshold: int) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes that go, and in how many spans."""
    if not runs:
        return raw, 0, 0
    out, end, spans, removed = [], 0, 0, 0
    for run in runs:  # in order of their starts
        lo, hi = run["lo"], run["hi"] + threshold
        if lo > end or not spans:
            out.append(raw[end:lo])
            spans += 1
            removed += hi - lo
        else:
            removed += max(0, hi - end)
        end = max(end, hi)
    out.append(raw[end:])
    return b"".join(out), removed, spans


def _kept_batches(batches, threshold):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches):
        rows = [
            (raw, *_kept(raw, runs, threshold))
            for raw, runs in zip(map(unpack, batch.column("text").to_pylist()), batch.column("runs").to_pylist())
        ]
        ids = batch.column("id").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NULL_ID),
             pa.array([len(r[0]) for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()),
             pa.array([r[3] for r in rows], pa.int64()),
             pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
             pa.array([r[1] for r in rows], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, counts, digest and the remaining bytes of every row."""
    packed = packed_texts(docs)
    return packed.join(repeated_runs(docs, packed, threshold), ["id", "part"], "left").mapInArrow(
        partial(_kept_batches, threshold=threshold),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )


def _cut_batches(batches, threshold, names_out):
    for batch in slices(batches):
        texts = [
            None if raw is None else _kept(raw, runs, threshold)[0].decode("utf-8", "ignore")
            for raw, runs in zip(
                batch.column("text").cast(pa.binary()).to_pylist(),
                batch.column("__suffix_runs").to_pylist(),
            )
        ]
        changed = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names_out:
            kind = batch.column("n_chars").type
            changed["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(kind)
        yield pa.RecordBatch.from_arrays(
            [changed.get(n, batch.column(n)) for n in names_out], names_out
        )


def cut_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """All rows and columns, with repeats cut out of ``text`` and ``n_chars`` counted anew.

    A character of which only some bytes are repeats goes as a whole.
    """
    runs = repeated_runs(docs, packed_texts(docs), threshold).select(
        F.col("id").alias("__suffix_id"), F.col("part").alias("__suffix_part"),
        F.col("runs").alias("__suffix_runs"),
    )
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    keyed = docs.mapInArrow(
        partial(_part_batches, names_out=docs.columns),
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __suffix_part int",
    ).withColumn("__suffix_id", own_id)
    return keyed.join(runs, ["__suffix_id", "__suffix_part"], "left").select(
        *docs.columns, "__suffix_runs"
    ).mapInArrow(
        partial(_cut_batches, threshold=threshold, names_out=docs.columns), docs.schema
    )


def _part_batches(batches, names_out):
    for batch in slices(batches):
        part = [
            text_key(i, t)
            for i, t in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names_out] + [pa.array(part, pa.int32())],
            names_out + ["__suffix_part"],
        )
