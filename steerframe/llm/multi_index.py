"""Nearest neighbours by multi-index hashing of learned binary codes.

Rotations learned on a bounded sample (iterative quantisation) turn vectors into codes: the
signs of the rotated components. Codes are split into substrings of 16 bits, each indexed by
its value. A code within a Hamming radius of ``m (s + 1) - 1`` has one of its ``m`` substrings
within ``s`` of the query's, so probing all substrings level by level retrieves every code
within a radius that grows. Codes in the radius are reranked with the original vectors. A
query stops once the radius holds all but a few codes of vectors as near as its k-th. Levels
that would ask the tables for more values than a block has rows are taken at once, by the
distances of the block's codes; they retrieve the same codes.

Every row is indexed. Rows and queries are dealt into blocks, and each pair of blocks is a
task of bounded size, so no task holds one cluster or all queries.

Defined results: vectors that are null or zero, or hold null or non-finite components, and
rows with a null id take no part, nor do vectors whose length is not the most common one. Rows
with the query's id are its own; rows of one id count as one, with their best score. Ties go
to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: vectors that the rotations are learned on, at most
FIT_ROWS = 10_000
BITS, SUBSTRING = 256, 16
STEPS = 30
#: rows and queries of a task, on average
BLOCK, QUERIES = 8192, 512
#: values are probed while they are no more than this part of a block's rows
PROBES = 16
#: standard deviations by which the radius exceeds the expected distance of the k-th
MARGIN = 2.0

SCHEMA = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Codes:
    """Rotations, one after the other, as one matrix from components to bits."""

    matrix: np.ndarray

    @property
    def bits(self) -> int:
        return self.matrix.shape[1]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        if not len(vectors):
            return np.zeros((0, self.bits // SUBSTRING), np.uint16)
        signs = vectors @ self.matrix > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint16)


def _unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    scaled = vectors / np.where(top > 0, top, 1)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def learn(sample: np.ndarray, dim: int, bits: int = BITS) -> Codes:
    """Rotations that bring unit vectors close to the corners of the cube."""
    unit = _unit(sample) if len(sample) else np.zeros((0, dim))
    parts, made = [], 0
    while made < bits or made % SUBSTRING:
        start = np.random.default_rng(made).standard_normal((dim, dim))
        turn, _ = np.linalg.qr(start)
        for _ in range(STEPS if len(unit) >= dim else 0):
            turned = unit @ turn
            u, _, vt = np.linalg.svd(np.sign(turned).T @ unit)
            turn = (u @ vt).T
        take = dim if made + dim <= bits else min(dim, max(bits - made, -made % SUBSTRING))
        parts.append(turn[:, :take])
        made += take
    return Codes(np.concatenate(parts, 1))


class SubstringIndex:
    """Rows by the value of one substring."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = np.argsort(values, kind="stable")
        self.keys, starts = np.unique(values[self.order], return_index=True)
        self.starts = np.append(starts, len(values))

    def probe(self, value: int, level: int, masks: np.ndarray) -> np.ndarray:
        """Rows whose substring differs in exactly ``level`` bits."""
        if len(masks) < len(self.keys):
            wanted = masks ^ np.uint16(value)
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            at = at[self.keys[at] == wanted]
        else:  # fewer buckets than values to ask for
            at = np.flatnonzero(np.bitwise_count(self.keys ^ np.uint16(value)) == level)
        parts = [self.order[self.starts[i] : self.starts[i + 1]] for i in at]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _masks(level: int) -> np.ndarray:
    return np.array(
        [sum(1 << b for b in bits) for bits in combinations(range(SUBSTRING), level)], np.uint16
    )


def needed_radius(cosine: float, bits: int) -> float:
    """A radius that holds nearly all codes of vectors with at least this cosine."""
    share = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return bits * share + MARGIN * (bits * share * (1 - share)) ** 0.5


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of different ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


class _Found:
    """The k nearest so far of one query."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> None:
        self.unit, self.ids, self.query, self.k = unit, ids, query, k
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def rerank(self, rows: np.ndarray) -> None:
        if len(rows):
            scores = np.concatenate([self.scores, self.unit[rows] @ self.query])
            rows = np.concatenate([self.rows, rows])
            best = _best(self.ids[rows], scores, self.k)
            self.rows, self.scores = rows[best], scores[best]

    def radius(self, bits: int) -> float:
        """The radius at which the search may end."""
        return needed_radius(self.scores[-1], bits) if len(self.rows) == self.k else bits


def _probe(found: _Found, code, own, index, masks, skipped) -> bool:
    """Probe level by level while that asks for few values; whether the search has ended."""
    retrieved, waiting = skipped.copy(), np.zeros(0, np.int64)
    for level, masks_here in enumerate(masks):
        new = np.unique(np.concatenate(
            [part.probe(int(value), level, masks_here) for part, value in zip(index, code)]
        ))
        new = new[~retrieved[new]]
        retrieved[new] = True
        waiting = np.concatenate([waiting, new])
        radius = len(index) * (level + 1) - 1
        apart = np.bitwise_count(own[waiting] ^ code).sum(1, dtype=np.int64)
        found.rerank(waiting[apart <= radius])
        waiting = waiting[apart > radius]
        if radius >= found.radius(own.shape[1] * SUBSTRING):
            return True
    return False


def _sweep(found: _Found, apart: np.ndarray, skipped: np.ndarray, bits: int) -> None:
    """The rest of the levels at once, where they would ask for more values than rows."""
    open_rows = ~skipped
    open_rows[found.rows] = False
    if not open_rows.any():
        return
    # the nearest codes bound the radius that is needed
    count = min(int(open_rows.sum()), 4 * found.k)
    far = np.where(open_rows, apart, bits + 1)
    first = np.argpartition(far, count - 1)[:count]
    found.rerank(first)
    open_rows[first] = False
    found.rerank(np.flatnonzero(open_rows & (apart <= found.radius(bits))))


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    codes: Codes, k: int,
):
    """For each query the k nearest rows of a block: query number, rows, scores."""
    unit, unit_queries = _unit(vectors), _unit(queries)
    own, asked = codes.of(unit), codes.of(unit_queries)
    parts = own.shape[1]
    index = [SubstringIndex(own[:, j]) for j in range(parts)]
    masks = [_masks(0)]
    while len(masks) <= SUBSTRING:
        more = _masks(len(masks))
        if parts * (len(more) + sum(map(len, masks))) > len(own) // PROBES:
            break
        masks.append(more)
    words = np.ascontiguousarray(np.pad(own, ((0, 0), (0, -parts % 4)))).view(np.uint64)
    asked_words = np.ascontiguousarray(np.pad(asked, ((0, 0), (0, -parts % 4)))).view(np.uint64)
    for start in range(0, len(queries), 64):
        searches = []
        for q in range(start, min(start + 64, len(queries))):
            found = _Found(unit, ids, unit_queries[q], k)
            skipped = ids == query_ids[q]  # never a neighbour of itself
            ended = _probe(found, asked[q], own, index, masks, skipped)
            searches.append((q, found, skipped, ended))
        rest = [s for s in searches if not s[3]]
        if rest:
            rows = np.array([s[0] for s in rest])
            apart = np.zeros((len(rest), len(own)), np.int16)
            for word in range(words.shape[1]):
                apart += np.bitwise_count(asked_words[rows, word][:, None] ^ words[:, word][None, :])
            for (_, found, skipped, _), distance in zip(rest, apart):
                _sweep(found, distance, skipped, codes.bits)
        for q, found, _, _ in searches:
            yield q, found.rows, found.scores


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search_cell(rows: pa.Table, queries: pa.Table, codes: Codes, dim: int, k: int) -> pa.Table:
    out = [], [], []
    if rows.num_rows and queries.num_rows:
        ids, query_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        for q, near, scores in search_block(
            ids, _matrix(rows["vec"], dim), query_ids, _matrix(queries["vec"], dim), codes, k
        ):
            out[0].append(np.full(len(near), query_ids[q]))
            out[1].append(ids[near])
            out[2].append(scores)
    columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table({
        "query_id": pa.array(columns[0].astype(np.int64)),
        "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float)),
    })


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part; ``vec`` as floats or doubles."""
    kind = dict(vectors.dtypes)[vec]
    kind = kind if kind == "array<float>" else "array<double>"
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast(kind).alias("vec")
    ).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, vec: str = "embedding",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of ids divisible by ``every``."""
    rows = usable(vectors, vec)
    sizes = rows.groupBy(F.size("vec").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), "dim").first()
    dim, n = (common["dim"], common["count"]) if common else (1, 0)
    rows = rows.filter(F.size("vec") == dim)
    sample = (
        rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vec")).limit(fit_rows).toArrow()
    )
    codes = learn(_matrix(sample["vec"], dim), dim)
    blocks, query_blocks = max(1, ceil(n / BLOCK)), max(1, ceil(n / every / QUERIES))

    def dealt(df: DataFrame, own: int, other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(own))
        return df.select(
            "vec_id", "vec", mine.alias("mine"),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("theirs"),
        )

    left = dealt(rows, blocks, query_blocks).withColumn(
        "cell", F.col("mine") * query_blocks + F.col("theirs")
    )
    right = dealt(rows.filter(F.col("vec_id") % every == 0), query_blocks, blocks).withColumn(
        "cell", F.col("theirs") * query_blocks + F.col("mine")
    )

    def searched(rows: pa.Table, queries: pa.Table) -> pa.Table:
        return _search_cell(rows, queries, codes, dim, k)

    found = (
        left.select("cell", "vec_id", "vec").groupBy("cell")
        .cogroup(right.select("cell", "vec_id", "vec").groupBy("cell"))
        .applyInArrow(searched, SCHEMA)
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
