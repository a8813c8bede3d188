"""A sink for results that are revised while a stream runs: the last word on each key holds.

Every micro-batch writes its rows into a folder of its own, so a batch that is run again after
a failure replaces what it had written. Reading keeps, for each key, the row of the latest
batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from steerframe.schemas import require

EPOCH = "epoch"


def write_keyed(results: DataFrame, path: str, mode: str = "update") -> DataStreamWriter:
    """Write a streaming result whose rows may come again with other values."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")

    return results.writeStream.outputMode(mode).foreachBatch(keep)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The latest row of each key."""
    stored = T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType())])
    rows = spark.read.schema(stored).parquet(path)
    require(rows, keys, "read_keyed")
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), EPOCH).alias("_last")
    ).select(*keys, "_last.*")
