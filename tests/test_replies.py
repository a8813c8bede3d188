import datetime
import random

import pytest
from pyspark.sql import functions as F

from steerframe.catalog.replies import run_keyed
from steerframe.streaming import keyed, replies as rp

START = datetime.datetime(2024, 1, 1)
SCHEMA = "key long, seq long, ts timestamp, text string"


def chunk(key, seq, text, second=None):
    return (key, seq, START + datetime.timedelta(seconds=seq if second is None else second), text)


def batch(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = rp.accumulate_batch(df, "STOP", options.pop("max_chunks", None), **options)
    return sorted((r.key, r.seq, r.reply) for r in out.collect())


def test_cumulative_until_stop(spark):
    rows = [chunk(1, i, t) for i, t in enumerate(["a", "b", "STOP", "c"])]
    assert batch(spark, rows) == [(1, 0, "a"), (1, 1, "ab")]


def test_incomplete_piece_joins_the_next(spark):
    rows = [chunk(1, i, t) for i, t in enumerate(["a", "b�", "c"])]
    assert batch(spark, rows) == [(1, 0, "a"), (1, 2, "ab�c")]
    assert len(batch(spark, rows, hold_incomplete=False)) == 3


def test_gap_duplicate_cap_and_global_stop(spark):
    rows = [chunk(1, 0, "a"), chunk(1, 0, "late copy", 9), chunk(1, 2, "after a gap")]
    assert batch(spark, rows) == [(1, 0, "a")]
    full = [chunk(1, i, str(i)) for i in range(5)]
    assert batch(spark, full, max_chunks=2)[-1] == (1, 1, "01")
    stop_at = START + datetime.timedelta(seconds=3)
    assert batch(spark, full, stop_at=stop_at)[-1] == (1, 2, "012")


def test_long_reply_and_null_text(spark):
    rows = [chunk(1, i, None if i == 1 else "x") for i in range(300)]
    got = batch(spark, rows)
    assert len(got) == 300
    assert got[1] == (1, 1, "x") and got[-1] == (1, 299, "x" * 299)


def random_chunks(seed):
    rng, rows = random.Random(seed), []
    for key in range(30):
        for seq in range(rng.randint(1, 15)):
            text = rng.choice(["x", "yy", "z�", "STOP"] if seq > 3 else ["x", "yy", "z�"])
            rows.append(chunk(key, seq, text))
            if rng.random() < 0.2:
                rows.append(chunk(key, seq, "copy", seq + 100))
    rng.shuffle(rows)
    return rows


def write_files(spark, rows, folder, files):
    for i in range(files):
        part = spark.createDataFrame(rows[i::files], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)


def test_stream_equals_batch_out_of_order(spark, tmp_path):
    rows = [r for r in random_chunks(1) if r[3] != "copy"]
    folder = str(tmp_path / "in")
    write_files(spark, rows, folder, 5)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run_keyed(
        spark, rp.accumulate_stream(stream, "STOP", 12, late="1 day"), ["key", "seq"], "append"
    )
    assert stands(out) == batch(spark, rows, max_chunks=12)


def stands(out):
    """The replies that hold: a null takes one back."""
    return sorted((r.key, r.seq, r.reply) for r in out.filter("reply IS NOT NULL").collect())


@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("as_bytes", [False, True])
def test_stream_with_copies_in_any_order_equals_batch_and_restarts(spark, tmp_path, seed, as_bytes):
    """Copies of another time, text and stop marker, before and after what they repeat."""
    rng, rows = random.Random(seed), []
    for key in range(25):
        for seq in range(rng.randint(1, 12)):
            for _ in range(rng.choice([1, 1, 2, 3])):
                text = rng.choice(BYTES if as_bytes else [*["x", "yy", "z\ufffd"] * 3, "STOP"])
                rows.append(chunk(key, seq, text, rng.randint(0, 99)))
    rng.shuffle(rows)
    schema = SCHEMA.replace("text string", "text binary") if as_bytes else SCHEMA
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    third = len(rows) // 3

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        replies = rp.accumulate_stream(stream, "STOP", late="1 day")
        query = (
            keyed.write_keyed(replies, out, "append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for at in range(0, len(rows), third):
        spark.createDataFrame(rows[at : at + third], schema).coalesce(2).write.mode("append").parquet(folder)
        run()
    replies = rp.accumulate_stream(spark.readStream.schema(schema).parquet(folder), "STOP")
    got = stands(keyed.read_keyed(spark, out, replies.schema, ["key", "seq"]))
    want = rp.accumulate_batch(spark.createDataFrame(rows, schema), "STOP")
    assert got == sorted((r.key, r.seq, r.reply) for r in want.collect())
    assert len(got) > (8 if as_bytes else 40)


# pieces of characters of two, three and four bytes, whole texts, and a stop marker
BYTES = [
    b"a", b"", "\u00e9".encode(), "\u00e9".encode()[:1], "\u00e9".encode()[1:], b"\xe2\x82", b"\xac",
    b"\xf0\x9f", b"\x98\x80", b"STOP",
]


def test_bytes_against_a_plain_decoder(spark):
    rng, rows, want = random.Random(8), [], []
    texts = ["na\u00efve \u20ac", "\U0001F600\U0001F601", "plain", "\u0e01\u0e02x", ""]
    for key in range(40):
        raw = b"".join(rng.choice(texts).encode() for _ in range(6))
        if key % 10 == 9:
            raw = raw[:9] + b"\xff" + raw[9:]  # nothing can follow
        cuts = sorted(rng.randint(0, len(raw)) for _ in range(rng.randint(0, 20)))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        rows += [(key, i, START, part) for i, part in enumerate(parts)]
        for i in range(len(parts)):
            try:
                want.append((key, i, b"".join(parts[: i + 1]).decode()))
            except UnicodeDecodeError:
                pass
    df = spark.createDataFrame(rows, SCHEMA.replace("text string", "text binary"))
    for block in (1, 3, 1024):
        out = rp.accumulate_batch(df, "STOP", block=block).collect()
        assert sorted((r.key, r.seq, r.reply) for r in out) == want
        assert not any("\ufffd" in r.reply for r in out)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_join_like_one(spark, block):
    rows = random_chunks(6) + [chunk(50, 2, "starts late"), chunk(51, 0, "STOP")]
    rows += [chunk(52, i, "t") for i in range(10) if i != 6]
    assert batch(spark, rows, block=block) == batch(spark, rows)


def test_no_task_holds_a_hot_key(spark):
    """The chunks of one key spread: no group, window or list goes by the key alone."""
    df = spark.range(3000).select(
        F.lit(1).cast("long").alias("key"), F.col("id").alias("seq"),
        F.lit(START).alias("ts"), F.lit("x").alias("text"),
    )
    out = rp.accumulate_batch(df, "STOP", block=100)
    # chunks are counted by (key, number), (key, block); by key only the blocks' short rows
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text
    rows = out.select("seq", F.length("reply").alias("n")).collect()
    assert all(r.n == r.seq + 1 for r in rows) and len(rows) == 3000


def test_last_windows_are_reported(spark, tmp_path):
    rows = [("a", START + datetime.timedelta(hours=h)) for h in range(30)]
    schema = "k string, ts timestamp"
    for at in range(0, 30, 10):
        part = spark.createDataFrame(rows[at : at + 10], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    daily = rp.throughput_stream(stream, ["k"], "1 day", "1 hour")
    out = run_keyed(spark, daily, ["window", "k"], "update").orderBy("window").collect()
    assert [(r.seconds, r.items) for r in out] == [(23 * 3600.0, 24), (5 * 3600.0, 6)]


def test_throughput(spark):
    rows = [(1, START, 5), (1, START + datetime.timedelta(seconds=4), 7), (2, START, 1)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, size int")
    got = {r.k: r for r in rp.throughput(df, ["k"], "size").collect()}
    assert (got[1].seconds, got[1].items, got[1].items_per_second, got[1].prior_size) == (
        4.0, 2, 0.5, 7,
    )
    assert got[2].items_per_second is None


@pytest.mark.parametrize("seq", [-1, 100])
def test_numbers_outside_the_cap(spark, seq):
    assert batch(spark, [chunk(1, 0, "a"), chunk(1, seq, "b", 1)]) == [(1, 0, "a")]


def test_state_is_bounded(spark):
    df = spark.createDataFrame([chunk(1, i, "x") for i in range(1000)], SCHEMA)
    assert rp.within_cap(df, 12).count() == 12
    assert rp.accumulate_batch(df, "STOP", 12).agg(F.max("seq")).first()[0] == 11


def test_long_reply_is_cut_into_few_wide_blocks(spark):
    """Of both: a reply of many blocks, and one that fits the blocks as they are."""
    ends = spark.createDataFrame([(n,) for n in (1, 256, 257, 3000, 10**9)], "n long")
    width = rp.block_width(F.col("n"), 2)
    got = [(r.n, r.width) for r in ends.select("n", width.alias("width")).collect()]
    assert [w for _, w in got[:3]] == [2, 2, 4]
    assert all(w % 2 == 0 and -(-n // w) <= rp.REPLY_BLOCKS for n, w in got)
    texts = [f"<{i}>" for i in range(3000)]
    rows = [chunk(1, i, t) for i, t in enumerate(texts)]
    rows += [chunk(2, i, t) for i, t in enumerate(texts[:1000])] + [chunk(2, 1000, "STOP")]
    out = batch(spark, rows, block=2)
    assert out == [(k, i, "".join(texts[: i + 1])) for k, n in ((1, 3000), (2, 1000)) for i in range(n)]


@pytest.mark.parametrize("kind", ["string", "binary"])
@pytest.mark.parametrize("block", [1, 2, 1024])
def test_characters_are_those_of_the_text(spark, kind, block):
    """Of whole and cut characters, and in strings that hold bytes of no character."""
    rng, rows = random.Random(11), []
    for key in [*range(20), None]:
        for seq in range(12):
            rows.append(chunk(key, seq, rng.choice([t for t in BYTES if t != b"STOP"] + [b"\xff", b"z\xef\xbf\xbd"])))
    rows += [chunk(50, i, t.encode()) for i, t in enumerate(["na\u00efve", "", "\U0001F600\u20ac", "STOP", "x"])]
    chunks = spark.createDataFrame(rows, SCHEMA.replace("text string", "text binary"))
    chunks = chunks.withColumn("text", F.col("text").cast(kind))
    out = rp.accumulate_batch(chunks, "STOP", block=block, length="n")
    assert out.columns == ["key", "seq", "reply", "n"]
    found = out.select("key", "seq", "n", F.length("reply").cast("long").alias("counted")).collect()
    assert found and all(r.n == r.counted for r in found)
    assert sorted((r.seq, r.n) for r in found if r.key == 50) == [(0, 5), (1, 5), (2, 7)]
    assert len(found) == rp.accumulate_batch(chunks, "STOP", block=block).count()


def test_replies_are_made_by_many_tasks(spark):
    """Short rows of which long replies are made: not by the few tasks that the rows would fill."""
    df = spark.range(2000).select(
        F.lit(1).cast("long").alias("key"), F.col("id").alias("seq"),
        F.lit(START).alias("ts"), F.lit("x").alias("text"),
    )
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = rp.accumulate_batch(df, "STOP", block=10)
        rows = out.select("seq", F.length("reply").alias("n"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert sorted((r.seq, r.n) for r in rows) == [(i, i + 1) for i in range(2000)]
    assert len({r.task for r in rows}) > 20


def test_a_block_of_many_bytes_is_cut_into_slices(spark, monkeypatch):
    rows = random_chunks(7) + [chunk(52, i, f"<{i}>") for i in range(400)]
    rows += [chunk(None, i, "t") for i in range(30)] + [chunk(53, 0, "STOP")]
    whole = rp.accumulate_batch(spark.createDataFrame(rows, SCHEMA), "STOP", length="n").collect()
    assert [r.reply for r in sorted(whole, key=lambda r: r.seq) if r.key is None] == ["t" * n for n in range(1, 31)]
    monkeypatch.setattr(rp, "SLICE_BYTES", 2000)
    frame = spark.createDataFrame([(0, 100), (1, 100), (2, 100), (3, 100), (0, 1), (3, 10**9)], "place int, size int")
    slices = rp.block_slices(F.col("place"), F.lit(50), F.lit(200), F.col("size"))
    assert [r[0] for r in frame.select(slices).collect()] == [1, 2, 2, 3, 1, rp.BLOCK_SLICES]
    for block in (64, 1024):
        cut = rp.accumulate_batch(spark.createDataFrame(rows, SCHEMA), "STOP", block=block, length="n")
        assert sorted(cut.collect(), key=repr) == sorted(whole, key=repr)
    # all of one block, by several tasks
    assert cut.filter("key = 52").select(F.spark_partition_id()).distinct().count() > 1
