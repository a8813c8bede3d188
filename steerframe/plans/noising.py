"""Bounded noise on the vectors of a layer: which positions, how much, which way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steerframe.functions import noise as ns
from steerframe.operators.curves import shaped_dose
from steerframe.operators.vectors import rotate_random, select_span


def dose_vectors(
    vectors: DataFrame,
    curves: DataFrame,
    key: Column,
    seed: int,
    noise: ns.Noise = ns.HASHED,
) -> DataFrame:
    """Rotate the vectors in the open span by at most their site's dose at their block.

    ``vectors`` hold ``site``, ``block_idx``, ``total_blocks`` and the columns of
    ``select_span``; ``curves`` one row per site.
    """
    columns = vectors.columns
    dosed = shaped_dose(select_span(vectors), curves, ["site"])
    theta = F.when(F.col("in_span"), F.col("shaped_dose")).otherwise(0.0)
    return rotate_random(dosed, theta, key, seed, noise=noise).select(*columns)
