"""Running sums that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from steerframe.operators.skew import attach

# Order values per block; a block's rows are the largest unit one task must sort.
BLOCK = 10_000


def block_of(order: Column, block: int) -> Column:
    return F.floor(order / F.lit(block)).cast("long")


def running_sum(
    rows: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    exclusive: bool = False,
    total: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to and including this one.

    ``order`` is an integer column, distinct within a group. A group is cut into
    blocks of consecutive order values: rows are summed inside their block, block
    totals (one row each, pre-aggregated before the shuffle) are summed across
    blocks, and the two are added. Both steps share one partitioning of the rows.
    ``total`` names a column for the sum of the whole group, taken from the same totals.
    """
    blocked = rows.withColumn("_block", block_of(F.col(order), block)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_block")
    upto = -1 if exclusive else Window.currentRow
    local = blocked.withColumn(
        "_local",
        F.coalesce(
            F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, upto)), F.lit(0)
        ),
    )
    before = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
    )
    if total:
        before = before.withColumn(total, F.sum("_sum").over(Window.partitionBy(*keys)))
    before = before.drop("_sum")
    return (
        attach(local, before, [*keys, "_block"], "inner")
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_block", "_value", "_local", "_before")
    )
