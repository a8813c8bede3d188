"""What the plans must look like for large data, checked on the plans themselves."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from steerframe.catalog import params
from steerframe.operators import skew

SF_DIR = "/root/testdata/sf0.001"
# read from files they wrote themselves, or from a checkpoint
INDIRECT = {
    "accumulate_reply_bytes_stream", "accumulate_reply_stream", "apply_stack", "apply_updates_callback", "apply_updates_stream", "throughput_stream",
    "write_read_chosen", "write_read_documents", "write_read_params",
}
OWN = {name for family in entry_point.FAMILIES for name in family.QUERIES}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(OWN - INDIRECT))
def test_no_cross_join_and_no_single_task(no_broadcast, name):
    text = plan(entry_point.queries()[name](no_broadcast, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # only the one-row result of a whole-table mean may end in a single task
    if name != "angle_audit_tables":
        assert "SinglePartition" not in text.replace("TakeOrderedAndProject", "")


@pytest.mark.parametrize(
    "name", ["parse_sections", "resolve_sections", "expand_placeholders", "merge_contexts",
             "fan_out_variants", "strip_markers", "clean_turns", "keep_last", "strip_leading",
             "remaining_budget", "mask_finished_arrays", "rotate_random", "split_heads",
             "mask_tail", "curve_at", "merge_profiles", "flatten_params", "values_only",
             "selected_profiles", "index_map_attn_to_layer", "index_map_layer_to_attn"],
)
def test_row_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(entry_point.queries()[name](spark, SF_DIR))


@pytest.fixture
def small_skew(no_broadcast):
    """Thresholds of adaptive skew splitting that fit small tables."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {key: no_broadcast.conf.get(key) for key in conf}
    for key, value in conf.items():
        no_broadcast.conf.set(key, value)
    yield no_broadcast
    for key, value in old.items():
        no_broadcast.conf.set(key, value)


def attached(spark, folder, key):
    """Rows of one group each, with their group's largest id, and where each row ended up."""
    rows = spark.range(40_000).select(key.alias("g"), "id", F.repeat(F.lit("x"), 20).alias("pad"))
    rows.repartition(16).write.parquet(folder)
    rows = spark.read.parquet(folder)
    out = skew.attach(rows, rows.groupBy("g").agg(F.max("id").alias("top")), ["g"])
    return out.select("g", "id", "top", F.spark_partition_id().alias("task"))


def test_hot_null_group_is_spread_over_tasks(small_skew, tmp_path):
    key = F.when(F.col("id") % 3 > 0, F.col("id"))
    out = attached(small_skew, str(tmp_path / "rows"), key)
    rows = out.collect()
    assert len(rows) == 40_000
    assert {r.top for r in rows if r.g is None} == {39_999}
    assert all(r.top == r.g for r in rows if r.g is not None)
    assert len({r.task for r in rows if r.g is None}) > 3
    assert "skew=true" in plan(out)


def test_many_hot_groups_need_no_pass_to_find_them(small_skew, tmp_path):
    """3,000 groups of 13 rows in two of 40 partitions: both partitions are split."""
    # the hash that a null-safe join deals the rows by
    place = F.pmod(F.hash("id", F.lit(False)), F.lit(40))
    ids = small_skew.range(200_000).filter(place < 2).limit(3000)
    groups = [r.id for r in ids.collect()]
    listed = F.array(*[F.lit(g) for g in groups]).cast("array<long>")
    key = F.get(listed, (F.col("id") % len(groups)).cast("int"))
    out = attached(small_skew, str(tmp_path / "rows"), key)
    tasks = [r.task for r in out.collect()]
    assert max(tasks.count(t) for t in set(tasks)) < 10_000 and len(set(tasks)) > 10
    text = plan(out)
    assert "skew=true" in text
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert final.count("FileScan parquet") == 2
    assert "TakeOrdered" not in text and "Window" not in text


def test_scan_reads_only_what_is_needed(spark):
    df = entry_point.queries()["upsert"](spark, SF_DIR)
    assert "ReadSchema: struct<c_custkey:bigint>" in plan(df)


@pytest.mark.parametrize("name", ["lookup", "lookup_subtree", "redose"])
def test_values_of_trees_are_not_sent_whole_to_every_task(spark, name):
    """Made by user code, they are guessed far too small before they are there."""
    initial = plan(entry_point.queries()[name](spark, SF_DIR))
    assert "BroadcastHashJoin" not in initial and "SortMergeJoin" in initial


def test_trees_of_one_row_group_are_spread_over_tasks(spark, tmp_path):
    customers = spark.range(20_001).withColumnRenamed("id", "c_custkey")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("flatten_params", "values_only"):
        assert entry_point.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() == 5
    assert params.trees(spark, str(tmp_path)).distinct().count() == 20_001
