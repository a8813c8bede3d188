"""What the registered queries share: table access and derived inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a table of which one task makes trees, or whatever else is much more than the row.
SPREAD_ROWS = 5_000


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows evenly over tasks before much is made of each.

    Short rows lie together in few row groups, and one task would do all that follows for
    each row group. A table for one task is left as it is. The count comes from the files' footers.
    """
    tasks = -(-rows.count() // SPREAD_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )


def components(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """One row per component, rounded, for comparison with SQL."""
    return df.select(*keys, F.posexplode(vec).alias("i", "value")).select(
        *keys, F.col("i").cast("long").alias("i"), rounded(F.col("value")).alias("value")
    )


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def div(x: str, n: int) -> Column:
    return F.floor(F.col(x) / F.lit(n)).cast("long")


def mod(x: str, n: int) -> Column:
    return F.col(x) % F.lit(n)


def pick(x: Column, *values: str) -> Column:
    """The value numbered ``x``."""
    return F.get(F.array(*[F.lit(v) for v in values]), x.cast("int"))


# SQL for the components of every embedding, numbered from 0
SQL_COMPONENTS = """
c AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i,
         unnest(embedding)::DOUBLE AS x
  FROM embeddings
)"""
