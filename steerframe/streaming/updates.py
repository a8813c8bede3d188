"""Settings that change while a stream of updates runs.

Under one folder lie ``base``, settings as of some batch, ``changes``, the latest update of each
path in each later batch, and ``manifest``, which names for every batch the folders that make up
its settings. Settings are merged when they are read: of all values of a path the one with the
latest time holds, so it does not matter in which batch an update arrives. A batch writes only
its own changes; after some batches the changes are folded into a new base, and folders that
neither this batch nor the one before names go. Rows lie in buckets by owner, so that one
owner's settings are read from one bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from steerframe.schemas import PARAM, require

OnChange = Callable[[DataFrame, int], None]

BUCKETS = 16
COMPACT_AFTER = 8

# Tasks that write a bucket of some size side by side. Rows with paths are shuffled small, so
# adaptive execution alone would leave many of them to one task before it splits it.
WRITERS = 4

STORED = T.StructType(
    [*PARAM.fields, T.StructField("ts", T.TimestampType()), T.StructField("changed", T.BooleanType())]
)
MANIFEST = "epoch long, folder string, buckets int"


def _bucket(owner: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


def _latest(rows: DataFrame) -> DataFrame:
    """The value of each path with the latest time; any update is later than a base value."""
    return rows.groupBy("owner", "path").agg(
        F.max(F.struct("changed", "ts", "value")).alias("_last")
    ).select("owner", "path", "_last.value", "_last.ts", "_last.changed")


def _write(rows: DataFrame, folder: str, buckets: int) -> None:
    (
        rows.select(*STORED.names)
        .withColumn("bucket", _bucket(F.col("owner"), buckets))
        .withColumn("_writer", F.pmod(F.hash("owner", "path"), F.lit(WRITERS)))
        .hint("rebalance", "bucket", "_writer")
        .drop("_writer")
        .write.mode("overwrite").partitionBy("bucket").parquet(folder)
    )


def _manifests(spark: SparkSession, path: str) -> dict[int, tuple[list[str], int]]:
    """Folders and number of buckets by batch; a folder's name is one short row."""
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{path}/manifest")
    found: dict[int, tuple[list[str], int]] = {}
    for row in rows.collect():
        found.setdefault(row.epoch, ([], row.buckets))[0].append(row.folder)
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _stored(
    spark: SparkSession, path: str, folders: list[str], buckets: int, owner: str | None = None
) -> DataFrame:
    schema = T.StructType([*STORED.fields, T.StructField("bucket", T.IntegerType())])
    parts = [spark.read.schema(schema).parquet(f"{path}/{folder}") for folder in sorted(folders)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if owner is not None:
        rows = rows.filter(
            (F.col("owner") == owner) & (F.col("bucket") == _bucket(F.lit(owner), buckets))
        )
    return _latest(rows)


def read_settings(
    spark: SparkSession, path: str, epoch: int | None = None, owner: str | None = None
) -> DataFrame:
    """The settings after a batch, by default the last: owner, path, value and its time.

    ``owner`` limits them to one owner, whose bucket alone is read.
    """
    known = _manifests(spark, path)
    folders, buckets = known[max(known) if epoch is None else epoch]
    return _stored(spark, path, folders, buckets, owner).select(*PARAM.names, "ts")


def apply_updates(
    updates: DataFrame,
    base: DataFrame,
    path: str,
    on_change: OnChange | None = None,
    buckets: int = BUCKETS,
    compact_after: int = COMPACT_AFTER,
) -> DataStreamWriter:
    """Log each micro-batch of updates and call back with the settings as they now are.

    ``base`` holds the settings before the first batch. The callback is the place to rebuild
    what hangs on the settings, such as merged curves.
    """
    require(updates, [*PARAM.names, "ts"], "apply_updates")

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch == 0:
            first = base.select(
                *PARAM.names, F.lit(None).cast("timestamp").alias("ts"), F.lit(False).alias("changed")
            )
            _write(first, f"{path}/base/{epoch}", buckets)
            folders, before = [f"base/{epoch}"], {}
        else:
            before = {e: m for e, m in _manifests(spark, path).items() if e < epoch}
            folders = before[max(before)][0]
        changes = batch.select(
            *PARAM.names, F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("changed")
        )
        _write(_latest(changes), f"{path}/changes/{epoch}", buckets)
        folders = [*folders, f"changes/{epoch}"]
        if len(folders) > compact_after:
            # a folder of its own: the base written by batch 0 must survive its being run again
            _write(_stored(spark, path, folders, buckets), f"{path}/compacted/{epoch}", buckets)
            folders = [f"compacted/{epoch}"]
        manifest = [(epoch, folder, buckets) for folder in folders]
        spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").json(
            f"{path}/manifest/{epoch}"
        )
        if before:
            kept = {*folders, *before[max(before)][0]}
            for old in sorted(before)[:-1]:
                # changes that were folded into a base at once are in no manifest
                for folder in {*before[old][0], f"changes/{old}"} - kept:
                    _delete(spark, f"{path}/{folder}")
                _delete(spark, f"{path}/manifest/{old}")
        if on_change is not None:
            on_change(read_settings(spark, path, epoch), epoch)

    return updates.writeStream.foreachBatch(step)
