"""Repeatable uniform noise.

``rand()`` depends on partitioning and changes when a lost task is run again. These
depend only on the row's key, the component and the seed. Each kind exists for one
value per row, as a column, and for a block of vectors, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

# The multiply-and-square generator of ``ARITHMETIC``; SQL repeats these numbers.
MODULUS = 65521
KEY_STEP = 4867
COMPONENT_STEP = 6977
SEED_STEP = 1693


@dataclass(frozen=True)
class Noise:
    """``column(key, component, seed)`` per row; ``block(keys, n, seed)`` gives components
    0..n-1 for an array of integer keys, one row each."""

    column: Callable[[Column, Column, int], Column]
    block: Callable[[np.ndarray, int, int], np.ndarray]


def _hashed_column(key: Column, component: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, component, F.lit(seed)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of the public splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_block(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        start = _mixed(keys.astype(np.uint64) + np.uint64(seed % 2**64) * step)
        bits = _mixed(start[:, None] + (np.arange(1, n + 1, dtype=np.uint64) * step)[None, :])
    return (bits >> np.uint64(11)) * 2.0**-53


def _arithmetic_column(key: Column, component: Column, seed: int) -> Column:
    mixed = F.pmod(
        F.pmod(key, F.lit(MODULUS)) * KEY_STEP
        + component.cast("long") * COMPONENT_STEP
        + F.lit(seed * SEED_STEP),
        F.lit(MODULUS),
    )
    return F.pmod(mixed * mixed + mixed * 3 + 1, F.lit(MODULUS)).cast("double") / F.lit(
        float(MODULUS)
    )


def _arithmetic_block(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    mixed = (
        (keys % MODULUS * KEY_STEP)[:, None]
        + (np.arange(n) * COMPONENT_STEP)[None, :]
        + seed * SEED_STEP
    ) % MODULUS
    return (mixed * mixed + mixed * 3 + 1) % MODULUS / float(MODULUS)


# Uniform in [0, 1) with 53 bits.
HASHED = Noise(_hashed_column, _hashed_block)
# Uniform multiples of 1/65521 from an integer key: coarse, but plain SQL can compute
# the same numbers.
ARITHMETIC = Noise(_arithmetic_column, _arithmetic_block)
