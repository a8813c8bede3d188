"""Joining a per-group row back to the group's rows when one group may be huge.

The group keys are compared null-safely, so the rows whose key is null are a group like any
other. The join leaves both sides as plain shuffle stages under it: a group that is hot makes
its partition of rows large, and adaptive execution splits every such partition and repeats the
few group rows that belong to it (``spark.sql.adaptive.skewJoin``, on by default), however many
groups are hot and without a pass to find them. A small side is broadcast instead, by its size
as measured.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def null_safe(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Equality of the keys of two aliased frames, null equal to null."""
    return reduce(and_, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def too_large_to_copy(groups: DataFrame) -> DataFrame:
    """Mark rows that user code makes many of from few: the size that Spark guesses for them
    before they are there is far too small, so they are never sent whole to every task."""
    return groups.hint("merge")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``groups`` (one row per key) to ``rows`` (many per key): the columns of both."""
    others = [F.col(f"r.`{c}`") for c in groups.columns if c not in keys]
    return rows.alias("l").join(groups.alias("r"), null_safe(keys), how).select("l.*", *others)
