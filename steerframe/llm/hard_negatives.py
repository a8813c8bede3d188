"""Hard-negative mining: window searches around anchors, pruned along a spanning tree of anchors.

Vectors are whole numbers, a score is an inner product. The anchors of a block form a minimum
spanning tree under the Euclidean distance. If an anchor p has score s with a candidate x, then an
anchor c at distance d from p has a score within s - d * |x| and s + d * |x|. So a block of
candidates walks down the tree level by level with an interval for every (anchor, candidate); only
candidates whose interval overlaps the anchor's window are scored again, which makes the interval a
point. A first walk finds the positives (the window opens at the fifth best lower bound among
candidates of the anchor's label), a second the negatives (the window that the positives set).

How it runs in Spark: anchors are dealt into blocks of ``ANCHORS`` and candidates into blocks of
``CANDIDATES`` in turn, without regard to labels or values, so no label is a hot key. A cell is one
block of each; a cell hands on at most ``positives`` rows an anchor, then ``negatives`` rows a
positive, and a ranked window over those few puts the blocks together. All anchors meet all
candidates, as the result asks, in blocks: a candidate is copied once per ``ANCHORS`` anchors.

Defined results:

- Rows with a null id, label or vector, an empty vector, or a component that is null or not finite
  take no part. Vectors of another length than an anchor's are no candidates of it.
- Rows with the anchor's own id are never its candidates. A repeated row is as many candidates; an
  anchor id given several times is one anchor, that of the least label and vector.
- Other columns are ignored; an empty table gives an empty result.
- Products are taken in double precision where all their sums are below 2**53, else in Python
  integers; a score that does not fit a long fails the query.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialized

#: anchors and candidates of a cell, at most (in the mean of a deal in turn)
ANCHORS, CANDIDATES = 8192, 16384
#: (anchor, candidate) intervals that a walk holds at a time
CELLS = 4_000_000

# fixed values of the noise and of the scale of the vectors
LABELS, NOISY, SCALE = 10, 7, 256
ANCHOR_STEP = 100
# slack of the floating-point bounds
SLACK = 1.0 + 1e-9

RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long,"
    " positive_score long, negative_score long"
)


def noisy_labels(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): noise in the labels, vectors scaled to whole numbers."""
    label = F.col("label").cast("long")
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % NOISY == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"),
        F.transform("embedding", lambda x: x.cast("double")).alias("_raw"),
    ).filter(_usable(F.col("_raw"))).drop("_raw")


def _usable(vec: Column) -> Column:
    return (F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )


def _dealt(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.monotonically_increasing_id() % F.lit(blocks))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _exact(matrix: np.ndarray, other: np.ndarray) -> bool:
    """Whether all partial sums of the products stay exact in double precision."""
    bound = matrix.shape[1] * float(np.abs(matrix).max(initial=0)) * float(np.abs(other).max(initial=0))
    return bound < 2**53


# ---- the spanning tree


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent, edge length and level of each point in a minimum spanning tree from the first.

    Equal points hang on each other by edges of length zero.
    """
    n = len(points)
    exact, points = points, points.astype(np.float64)
    squares = np.einsum("ij,ij->i", points, points)
    parent, level = np.zeros(n, np.int64), np.zeros(n, np.int64)
    edge, inside = np.full(n, np.inf), np.zeros(n, bool)
    at = 0
    edge[0] = 0.0
    for _ in range(n):
        inside[at] = True
        level[at] = level[parent[at]] + 1 if at else 0
        apart = np.sqrt(np.maximum(squares + squares[at] - 2 * (points @ points[at]), 0.0))
        nearer = ~inside & (apart < edge)
        edge[nearer], parent[nearer] = apart[nearer], at
        at = int(np.argmin(np.where(inside, np.inf, edge)))
    # a length from a difference of squares is inexact where points are close: measure again
    apart = exact - exact[parent] if np.abs(points).max() < 2**52 else exact.astype(object) - exact[parent]
    return parent, np.linalg.norm(apart.astype(np.float64), axis=1) * SLACK, level


TREE = "anchor long, size int, node int, vec_id long, label long, vec array<long>, parent int, edge double, level int"


def _tree_rows(table: pa.Table) -> pa.Table:
    """The anchors of one block and one length, by level, with their place in the tree."""
    table = table.sort_by("vec_id")
    parent, edge, level = spanning_tree(_matrix(table["vec"]))
    order = np.argsort(level, kind="stable")
    node = np.empty(len(order), np.int64)
    node[order] = np.arange(len(order))
    out = table.select(["anchor", "size", "vec_id", "label", "vec"]).take(pa.array(order))
    columns = {
        "node": pa.array(np.arange(len(order)), pa.int32()),
        "parent": pa.array(node[parent[order]], pa.int32()),
        "edge": pa.array(edge[order]),
        "level": pa.array(level[order], pa.int32()),
    }
    for name, values in columns.items():
        out = out.append_column(name, values)
    return out.select([field.split()[0] for field in TREE.split(", ")])


# ---- the walk down the tree


class _Walk:
    """Score intervals of a block of candidates, level by level down a tree of anchors."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        self.vecs, self.cands = _matrix(anchors["vec"]), _matrix(candidates["vec"])
        kind = np.float64 if _exact(self.vecs, self.cands) else object
        self.vecs, self.cands = self.vecs.astype(kind), self.cands.astype(kind)
        self.parent, self.edge = anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
        self.level = anchors["level"].to_numpy()
        self.norm = np.linalg.norm(self.cands.astype(np.float64), axis=1) * SLACK
        # what double precision may lose of a score that is not below 2**53, per unit of |x|
        longest = np.linalg.norm(self.vecs.astype(np.float64), axis=1).max()
        self.rounding = 0.0 if kind is np.float64 else 1e-12 * longest
        self.rescored = self.met = 0

    def levels(self, wanted):
        """Yield (anchor numbers, lows, highs) of each level.

        ``wanted(nodes, lows, highs)`` tells which of a level's candidates to score again.
        """
        n = len(self.level)
        starts = np.searchsorted(self.level, np.arange(self.level[-1] + 2)) if n else [0]
        lows = highs = None
        first = 0
        for lo, hi in zip(starts[:-1], starts[1:]):
            nodes = np.arange(lo, hi)
            if lo == 0:
                low = np.full((hi, len(self.cands)), -np.inf)
                high = -low
            else:
                reach = self.edge[nodes][:, None] * self.norm[None, :]
                # sums of rounded numbers: step outwards by the slack
                reach = reach * SLACK + 1e-6 + self.rounding * self.norm[None, :]
                above = self.parent[nodes] - first
                low, high = lows[above] - reach, highs[above] + reach
            again = wanted(nodes, low, high) if lo else np.ones(low.shape, bool)
            self._rescore(nodes, again, low, high)
            self.met += again.size
            self.rescored += int(again.sum())
            yield nodes, low, high
            lows, highs, first = low, high, lo

    def _rescore(self, nodes, again, low, high) -> None:
        if again.mean() > 0.25 if again.size else False:
            scores = (self.vecs[nodes] @ self.cands.T).astype(np.float64)
            if self.vecs.dtype == object:
                scores = np.where(again, scores, np.nan)
                low[again] = high[again] = scores[again]
            else:
                low[:] = high[:] = scores
            return
        rows, columns = np.nonzero(again)
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            scores = (self.vecs[nodes[r]] * self.cands[c]).sum(axis=1).astype(np.float64)
            low[r, c] = high[r, c] = scores

    def scores(self, node: int, columns: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Scores as whole numbers; ``known`` holds those of the columns in double precision."""
        if self.vecs.dtype == object:
            return (self.cands[columns] @ self.vecs[node]).astype(np.int64)
        return np.rint(known).astype(np.int64)


def _slices(anchors: pa.Table, candidates: pa.Table):
    """Blocks of candidates so small that two levels of the tree fit in ``CELLS``."""
    level = anchors["level"].to_numpy()
    widest = int(np.bincount(level).max()) if len(level) else 1
    rows = max(64, CELLS // (2 * widest))
    for at in range(0, len(candidates), rows):
        yield candidates.slice(at, rows)


def _best(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Places of the highest scores, ties by the smaller id."""
    if len(scores) > 4 * limit:
        floor = np.partition(scores, len(scores) - limit)[len(scores) - limit]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))][:limit]
    return np.lexsort((ids, -scores))[:limit]


FOUND = "anchor_id long, vec_id long, score long"


def _positive_cells(limit: int, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    """The best candidates of each anchor's label in one cell."""
    names = [field.split()[0] for field in FOUND.split(", ")]
    found = []
    if len(anchors) and len(candidates):
        anchors = anchors.sort_by("node")
        labels, own = anchors["label"].to_numpy(), anchors["vec_id"].to_numpy()
        for part in _slices(anchors, candidates):
            ids, part_labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
            walk = _Walk(anchors, part)

            def eligible(nodes):
                return (part_labels == labels[nodes][:, None]) & (ids != own[nodes][:, None])

            def wanted(nodes, low, high):
                fits = eligible(nodes)
                lows = np.where(fits, low, -np.inf)
                if lows.shape[1] > limit:
                    floor = np.partition(lows, lows.shape[1] - limit, axis=1)
                    floor = floor[:, lows.shape[1] - limit][:, None]
                else:
                    floor = -np.inf
                return fits & (high >= floor)

            for nodes, low, high in walk.levels(wanted):
                fits = eligible(nodes) & (low == high)
                for i, node in enumerate(nodes):
                    columns = np.flatnonzero(fits[i])
                    scores = walk.scores(node, columns, low[i, columns])
                    best = _best(scores, ids[columns], limit)
                    found += [
                        (int(own[node]), int(v), int(s))
                        for v, s in zip(ids[columns][best], scores[best])
                    ]
    kinds = [pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*found)) or [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


NEGATIVE = (
    "anchor_id long, positive_rank int, positive_id long, positive_score long,"
    " negative_id long, negative_score long"
)


def _negative_cells(limit: int, low_percent: int, high_percent: int, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    """The best candidates of other labels inside each positive's window in one cell."""
    found = []
    if len(anchors) and len(candidates):
        anchors = anchors.sort_by("node")
        labels, own = anchors["label"].to_numpy(), anchors["vec_id"].to_numpy()
        positives = anchors["positives"].to_pylist()
        # the union of an anchor's windows; positives of a negative score have none
        reach = [[p["score"] for p in row or () if p["score"] >= 0] for row in positives]
        floor = np.array([low_percent * min(r) / 100 - 0.5 if r else np.inf for r in reach])
        roof = np.array([high_percent * max(r) / 100 + 0.5 if r else -np.inf for r in reach])
        for part in _slices(anchors, candidates):
            ids, part_labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
            walk = _Walk(anchors, part)

            def wanted(nodes, low, high):
                differs = part_labels != labels[nodes][:, None]
                differs &= ids != own[nodes][:, None]
                return differs & (high >= floor[nodes][:, None]) & (low <= roof[nodes][:, None])

            for nodes, low, high in walk.levels(wanted):
                inside = wanted(nodes, low, high) & (low == high)
                for i, node in enumerate(nodes):
                    columns = np.flatnonzero(inside[i])
                    if not len(columns):
                        continue
                    scores = walk.scores(node, columns, low[i, columns])
                    order = np.lexsort((ids[columns], -scores))
                    scores, names = scores[order], ids[columns][order]
                    for p in positives[node]:
                        least, most = low_percent * p["score"], high_percent * p["score"]
                        near = np.flatnonzero((100 * scores <= most) & (100 * scores >= least))[:limit]
                        found += [
                            (int(own[node]), p["rank"], p["vec_id"], p["score"], int(v), int(s))
                            for v, s in zip(names[near], scores[near])
                        ]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*found)) or [[]] * 6
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        [field.split()[0] for field in NEGATIVE.split(", ")],
    )


# ---- the job


def mine(
    vectors: DataFrame,
    anchor_step: int = ANCHOR_STEP,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    anchor_rows: int = ANCHORS,
    candidate_rows: int = CANDIDATES,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives inside the window.

    ``vectors`` holds vec_id, label and vec (whole numbers). Anchors are the rows whose id is
    divisible by ``anchor_step``; positives are an anchor's best other rows of its label; the
    window of a positive is ``low_percent`` to ``high_percent`` of its score.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("vec").cast("array<long>").alias("vec"),
        F.size("vec").alias("size"),
    ).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull()
        & (F.col("size") > 0) & F.forall("vec", lambda x: x.isNotNull())
    )
    rows = materialized(rows, "mining-vectors")
    anchors = (
        rows.filter(F.col("vec_id") % anchor_step == 0).groupBy("vec_id")
        .agg(F.min(F.struct("label", "vec", "size")).alias("a")).select("vec_id", "a.*")
    )
    anchors = materialized(anchors, "mining-anchors")
    n_anchors, n_rows = anchors.count(), rows.count()
    anchor_blocks = max(1, -(-n_anchors // anchor_rows))
    blocks = max(1, -(-n_rows // candidate_rows))
    tree = materialized(
        _dealt(anchors, anchor_blocks, "anchor").groupBy("anchor", "size")
        .applyInArrow(_tree_rows, TREE),
        "mining-tree",
    )
    cell = ["anchor", "size", "block"]
    # a cell's candidates: each block once per block of anchors
    there = _dealt(rows, blocks, "block").withColumn(
        "anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_blocks - 1).cast("long")))
    )
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = (
        tree.withColumn("block", every_block).groupBy(*cell).cogroup(there.groupBy(*cell))
        .applyInArrow(partial(_positive_cells, positives), FOUND)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= positives)
    )
    listed = near.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")
    )
    aimed = materialized(
        tree.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left"),
        "mining-positives",
    )
    best = Window.partitionBy("anchor_id", "positive_rank").orderBy(
        F.desc("negative_score"), "negative_id"
    )
    return (
        aimed.withColumn("block", every_block).groupBy(*cell).cogroup(there.groupBy(*cell))
        .applyInArrow(partial(_negative_cells, negatives, low_percent, high_percent), NEGATIVE)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
