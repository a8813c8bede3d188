"""Softmax-weighted lookup of each query vector among the key vectors of its group.

The scores of a group are inherently all queries times all keys of the look-back
window, but no pair ever becomes a row. Positions are cut into tiles, each at least as
wide as the window. A query belongs to its own tile; a key is sent to its own tile and
to the neighbour whose queries can see it. So every cell holds all that its queries may
see, a bounded number of positions however long the group is, and the cells of a long
group are long
group are worked on in parallel. Inside a cell the scores are blocks of a matrix
product along the window's band.

Without a window every tile of queries meets every tile of keys of its group. The tiles of a
group are put together to stretches, a cell is a pair of stretches, and a group has so few of
them that its rows are copied a few times only, until a stretch is as long as a task should
hold. A cell hands on, for each query, the state of a softmax over its keys: the
sum of their weights and their weighted values, both relative to a base that is a multiple
of 32. States with one base add up, on the map side too, and the few bases of a query are
put together last. So no task sees more than two stretches, whatever the size of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from steerframe.functions import vectors as vx
from steerframe.operators.skew import null_safe
from steerframe.schemas import require

# Least tile width: small windows share a tile, so that cells are worth a task's time.
MIN_TILE = 1024

# Queries of a block inside a cell; its keys are those of its stretch of the window.
QUERY_BLOCK = 256

# Positions of a tile when there is no window.
UNBOUNDED_TILE = 4096

# Stretches that a group's tiles are put together to, and the most positions of one.
STRETCHES, STRETCH = 16, 32_768

# Distance of two bases of softmax states; exp() of it is far from overflow.
BASE = 32.0


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; null vectors and vectors of different lengths fail."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(vectors)
    if sizes.null_count or pc.count_distinct(sizes).as_py() > 1:
        raise ValueError("vectors of a lookup must be given and of one length")
    return flat.reshape(len(vectors), -1)


def _block_lookup(q_pos, q_vec, k_pos, k_vec, k_val, k_bias, window, causal):
    """Outputs of a block of queries, and whether each saw any key."""
    scores = q_vec @ k_vec.T / np.sqrt(q_vec.shape[1]) + k_bias
    gap = q_pos[:, None] - k_pos[None, :]
    visible = (gap < window) & (gap >= 0 if causal else gap > -window)
    scores = np.where(visible, scores, -np.inf)
    top = scores.max(axis=1, keepdims=True, initial=-np.inf)
    seen = np.isfinite(top[:, 0])
    weights = np.exp(scores - np.where(np.isfinite(top), top, 0.0))
    total = weights.sum(axis=1, keepdims=True)
    return (weights / np.where(total > 0, total, 1.0)) @ k_val, seen


def _cell_lookup(names: list[str], window: int, causal: bool):
    def lookup(queries: pa.Table, keys: pa.Table) -> pa.Table:
        queries = queries.sort_by("pos")
        kept = queries.select([*names, "head", "pos"])
        n = len(queries)
        if n == 0 or len(keys) == 0:
            return kept.append_column("out", pa.nulls(n, pa.list_(pa.float64())))
        keys = keys.sort_by("pos")
        q_pos, k_pos = queries["pos"].to_numpy(), keys["pos"].to_numpy()
        q_vec = _matrix(queries["_query"])
        k_vec, k_val = _matrix(keys["_key"]), _matrix(keys["_value"])
        k_bias = keys["_bias"].to_numpy()
        out, seen = np.zeros((n, k_val.shape[1])), np.zeros(n, dtype=bool)
        for at in range(0, n, QUERY_BLOCK):
            block = slice(at, at + QUERY_BLOCK)
            first, last = q_pos[block][0], q_pos[block][-1]
            lo = np.searchsorted(k_pos, first - window, "right")
            hi = np.searchsorted(k_pos, last if causal else last + window - 1, "right")
            near = slice(lo, hi)
            out[block], seen[block] = _block_lookup(
                q_pos[block], q_vec[block],
                k_pos[near], k_vec[near], k_val[near], k_bias[near], window, causal,
            )
        offsets = pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32())
        values = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~seen))
        return kept.append_column("out", values)

    return lookup


def _cell_states(names: list[str], causal: bool):
    def states(queries: pa.Table, keys: pa.Table) -> pa.Table:
        q_pos, k_pos = queries["pos"].to_numpy(), keys["pos"].to_numpy()
        q_vec, k_vec, k_val = (
            _matrix(queries["_query"]), _matrix(keys["_key"]), _matrix(keys["_value"])
        )
        k_bias = keys["_bias"].to_numpy()
        found = []
        for at in range(0, len(q_pos), QUERY_BLOCK):
            block = slice(at, at + QUERY_BLOCK)
            scores = q_vec[block] @ k_vec.T / np.sqrt(q_vec.shape[1]) + k_bias
            if causal:
                scores[q_pos[block][:, None] < k_pos[None, :]] = -np.inf
            top = scores.max(axis=1)
            seen = np.isfinite(top)
            base = np.rint(np.where(seen, top, 0.0) / BASE)
            weights = np.exp(scores - BASE * base[:, None])
            found.append((seen, base, weights.sum(axis=1), weights @ k_val))
        seen, base, total, values = (np.concatenate(part) for part in zip(*found))
        kept = queries.select([*names, "head", "pos"]).filter(pa.array(seen))
        values = values[seen]
        offsets = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
        return (
            kept.append_column("_base", pa.array(base[seen]))
            .append_column("_total", pa.array(total[seen]))
            .append_column("_values", pa.ListArray.from_arrays(offsets, pa.array(values.ravel())))
        )

    return lambda queries, keys: (
        states(queries, keys)
        if len(queries) and len(keys)
        else queries.select([*names, "head", "pos"]).slice(0, 0)
        .append_column("_base", pa.array([], pa.float64()))
        .append_column("_total", pa.array([], pa.float64()))
        .append_column("_values", pa.array([], pa.list_(pa.float64())))
    )


def _merged_states(states: DataFrame, query: list[str], dim: int | None) -> DataFrame:
    """Per query: the values of all its states, added up and divided by their weight."""
    by_base = states.withColumn("_one", F.lit(1.0)).groupBy(*query, "_base").agg(
        F.sum("_total").alias("_total"), vx.weighted_sum("_values", "_one", dim).alias("_values")
    )
    # as many entries as a query has bases
    listed = by_base.groupBy(*query).agg(
        F.collect_list(F.struct("_base", "_total", "_values")).alias("_states"),
        F.max("_base").alias("_top"),
    )

    def weight(state: Column) -> Column:
        return F.exp((state["_base"] - F.col("_top")) * BASE)

    total = F.aggregate("_states", F.lit(0.0), lambda t, s: t + s["_total"] * weight(s))
    added = F.aggregate(
        "_states",
        F.transform(F.get("_states", F.lit(0))["_values"], lambda _: F.lit(0.0)),
        lambda acc, s: F.zip_with(acc, vx.scale(s["_values"], weight(s)), lambda a, b: a + b),
    )
    return listed.select(*query, added.alias("_added"), total.alias("_sum")).select(
        *query, F.transform("_added", lambda x: x / F.col("_sum")).alias("out")
    )


def _with_stretches(tiles: DataFrame, names: list[str], tile: int) -> DataFrame:
    """Add the stretch of its group that a tile is in."""
    own = Window.partitionBy(*names)
    together = F.least(
        F.ceil(F.count(F.lit(1)).over(own) / F.lit(STRETCHES)), F.lit(max(1, STRETCH // tile))
    )
    place = F.row_number().over(own.orderBy("_tile")) - 1
    return tiles.withColumn("_stretch", F.floor(place / together).cast("long"))


def _unbounded(q: DataFrame, k: DataFrame, group: list[str], causal: bool, tile: int, dim) -> DataFrame:
    """Every tile of queries against every tile of keys that it may see, stretch by stretch."""
    names = [*group, "_key_head"]
    q = q.withColumn("_tile", F.floor(F.col("pos") / F.lit(tile)).cast("long"))
    k = k.withColumn("_tile", F.floor(F.col("pos") / F.lit(tile)).cast("long"))
    # one row for a tile of rows, numbered among the tiles of its group
    tiles = (
        q.select(*names, "_tile", F.lit(True).alias("_asks"))
        .unionByName(k.select(*names, "_tile", F.lit(False).alias("_asks")))
        .groupBy(*names, "_tile")
        .agg(F.max("_asks").alias("_asks"), F.max(~F.col("_asks")).alias("_answers"))
    )
    tiles = _with_stretches(tiles, names, tile)

    def of(side: str, name: str) -> DataFrame:
        return tiles.filter(side).select(*names, "_tile", F.col("_stretch").alias(name))

    q_tiles, k_tiles = of("_asks", "_q_tile"), of("_answers", "_k_tile")
    # and one for a pair of stretches
    pairs = q_tiles.drop("_tile").distinct().alias("l").join(
        k_tiles.drop("_tile").distinct().alias("r"), null_safe(names)
    ).select(*[F.col(f"l.{c}").alias(c) for c in names], "_q_tile", "_k_tile")
    if causal:
        pairs = pairs.filter("_k_tile <= _q_tile")

    def copied(rows: DataFrame, placed: DataFrame, own: str, other: str) -> DataFrame:
        reached = placed.alias("l").join(pairs.alias("r"), null_safe([*names, own])).select(
            "l.*", F.col(f"r.{other}").alias(other)
        )
        met = rows.alias("l").join(reached.alias("r"), null_safe([*names, "_tile"]))
        # aliases tell the columns of the two sides apart, which may come from one table
        own_columns = [F.col(f"l.{c}").alias(c) for c in rows.columns if c != "_tile"]
        return met.select(
            *own_columns, F.col(f"r.{own}").alias(own), F.col(f"r.{other}").alias(other)
        )

    cell = [*names, "_q_tile", "_k_tile"]
    fields = [f.simpleString().replace(":", " ", 1) for f in q.select(*group).schema]
    schema = ", ".join(
        [*fields, "head int", "pos long", "_base double", "_total double", "_values array<double>"]
    )
    states = (
        copied(q, q_tiles, "_q_tile", "_k_tile").groupBy(*cell)
        .cogroup(copied(k, k_tiles, "_k_tile", "_q_tile").groupBy(*cell))
        .applyInArrow(_cell_states(list(group), causal), schema)
    )
    query = [*group, "head", "pos"]
    merged = _merged_states(states, query, dim)
    return q.select(*query).alias("l").join(merged.alias("r"), null_safe(query), "left").select(
        "l.*", "r.out"
    )


def weighted_lookup(
    queries: DataFrame,
    keys: DataFrame,
    group: list[str],
    window: int | None = None,
    heads_per_key: int = 1,
    causal: bool = True,
    bias: Column | None = None,
    query_vec: str = "vec",
    key_vec: str = "key",
    value_vec: str = "value",
    tile: int = UNBOUNDED_TILE,
    dim: int | None = None,
) -> DataFrame:
    """Per query: mean of the visible values, weighted by softmax(q.k / sqrt(dim) + bias).

    ``queries`` holds the group columns, ``head``, ``pos`` and a vector; ``keys`` the
    same with ``head`` counting key heads, each shared by ``heads_per_key`` query heads.
    Positions are distinct within a group and head. A query at p sees the keys in
    (p - window, p], or in (p - window, p + window) when not causal; without a window it
    sees all keys up to its position, or all of its group. ``bias`` is an additive mask
    on the keys. A query that sees no key gets a null. A null group column is a value like
    any other.

    ``tile`` and ``dim`` hold without a window: the positions of a tile, and the values'
    length, if known.
    """
    require(queries, [*group, "head", "pos", query_vec], "weighted_lookup")
    require(keys, [*group, "head", "pos", key_vec, value_vec], "weighted_lookup")
    if window is None:
        unbounded_q = queries.select(
            *group,
            F.col("head").cast("int").alias("head"),
            F.col("pos").cast("long").alias("pos"),
            F.col(query_vec).alias("_query"),
            F.floor(F.col("head") / F.lit(heads_per_key)).cast("int").alias("_key_head"),
        )
        unbounded_k = keys.select(
            *group,
            F.col("head").cast("int").alias("_key_head"),
            F.col("pos").cast("long").alias("pos"),
            F.col(key_vec).alias("_key"),
            F.col(value_vec).alias("_value"),
            (F.lit(0.0) if bias is None else bias.cast("double")).alias("_bias"),
        )
        return _unbounded(unbounded_q, unbounded_k, list(group), causal, tile, dim)
    if window < 1:
        raise ValueError("window must be at least 1")
    width = max(window, MIN_TILE)
    tile = F.floor(F.col("pos") / F.lit(width)).cast("long")
    # the tile whose queries see this key from the far end of their window
    reach = F.array(tile, F.floor((F.col("pos") + window - 1) / F.lit(width)).cast("long"))
    if not causal:
        before = F.floor((F.col("pos") - window + 1) / F.lit(width)).cast("long")
        reach = F.concat(reach, F.array(before))
    cell = [*group, "_key_head", "_tile"]
    q = queries.select(
        *group,
        F.col("head").cast("int").alias("head"),
        F.col("pos").cast("long").alias("pos"),
        F.col(query_vec).alias("_query"),
        F.floor(F.col("head") / F.lit(heads_per_key)).cast("int").alias("_key_head"),
        tile.alias("_tile"),
    )
    k = keys.select(
        *group,
        F.col("head").cast("int").alias("_key_head"),
        F.col("pos").cast("long").alias("pos"),
        F.col(key_vec).alias("_key"),
        F.col(value_vec).alias("_value"),
        (F.lit(0.0) if bias is None else bias.cast("double")).alias("_bias"),
        F.explode_outer(F.array_distinct(reach)).alias("_tile"),
    )
    fields = [f.simpleString().replace(":", " ", 1) for f in queries.select(*group).schema]
    schema = ", ".join([*fields, "head int", "pos long", "out array<double>"])
    return (
        q.groupBy(*cell)
        .cogroup(k.groupBy(*cell))
        .applyInArrow(_cell_lookup(list(group), window, causal), schema)
    )
