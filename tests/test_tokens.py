import random

import pytest
from pyspark.sql import functions as F

from steerframe.functions import arrays as ar
from steerframe.operators import tokens as to


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def longs(*xs):
    return F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")


@pytest.mark.parametrize("n,expected", [(2, [2, 3]), (3, [1, 2, 3]), (9, [1, 2, 3])])
def test_keep_last(spark, n, expected):
    assert value(spark, ar.keep_last(longs(1, 2, 3), n)) == expected


@pytest.mark.parametrize(
    "tokens,expected",
    [([7, 7, 1, 7], [1, 7]), ([1, 7], [1, 7]), ([7, 7], []), ([], [])],
)
def test_strip_leading(spark, tokens, expected):
    assert value(spark, ar.strip_leading(longs(*tokens), 7)) == expected


@pytest.mark.parametrize(
    "a,b,expected",
    [([1, 2, 3], [1, 2, 4], 2), ([1, 2], [1, 2, 3], 2), ([1], [2], 0), ([], [1], 0)],
)
def test_common_prefix(spark, a, b, expected):
    assert value(spark, ar.common_prefix(longs(*a), longs(*b))) == expected


def test_mask_after_end(spark):
    assert value(spark, ar.mask_after_end(longs(1, 9, 2, 9, 3), [9], 0)) == [1, 9, 0, 0, 0]
    assert value(spark, ar.mask_after_end(longs(1, 2), [9], 0)) == [1, 2]


def test_prefix_reuse_backs_up_on_full_match(spark):
    seqs = spark.createDataFrame(
        [(1, 0, [1, 2]), (1, 1, [1, 2]), (1, 2, [1, 2, 3, 4]), (1, 3, [5])],
        "k long, step long, tokens array<long>",
    )
    out = to.prefix_reuse(seqs, ["k"]).orderBy("step").collect()
    assert [(r.reused, r.new) for r in out] == [(0, 2), (1, 1), (2, 2), (0, 1)]


@pytest.mark.parametrize("width,block", [(1, 1), (3, 4), (256, 10_000)])
def test_prefix_reuse_against_a_plain_loop(spark, width, block):
    rng, rows = random.Random(5), []
    for key in (None, 0, 1, 2):
        last = []
        for step in sorted(rng.sample(range(60), 40 if key == 2 else 5)):
            keep = rng.randint(0, len(last))
            last = last[:keep] + [rng.randint(0, 2) for _ in range(rng.randint(0, 6))]
            rows.append((key, step, list(last)))
    rows.append((3, 0, None))
    rows.append((3, 1, [1]))
    want, before = {}, {}
    for key, step, tokens in rows:
        old, n = before.get(key), 0
        while tokens and old and n < min(len(old), len(tokens)) and old[n] == tokens[n]:
            n += 1
        n -= bool(n and n == len(tokens))
        want[key, step] = (n, None if tokens is None else len(tokens) - n)
        before[key] = tokens
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, step int, tokens array<long>")
    got = {(r.k, r.step): (r.reused, r.new)
           for r in to.prefix_reuse(df, ["k"], width=width, block=block).collect()}
    assert got == want


def test_prefix_reuse_spreads_a_hot_key(spark):
    df = spark.range(2000).select(
        F.lit(1).alias("k"), F.col("id").alias("step"),
        F.sequence(F.lit(0), F.col("id") % 50).alias("tokens"),
    )
    out = to.prefix_reuse(df, ["k"], block=100)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    # windows number steps inside a block, or sum up blocks; no window holds tokens
    windows = [line for line in text.splitlines() if line.strip(" :+-|").startswith("Window")]
    assert windows and not any("token" in line for line in windows)
    assert out.filter("reused > 0").count() > 1900


def test_prefix_reuse_takes_shortest_of_batch(spark):
    seqs = spark.createDataFrame(
        [(1, 0, 0, [1, 2, 3]), (1, 1, 0, [1, 2, 3]), (1, 0, 1, [1, 2, 9]), (1, 1, 1, [1, 8, 3])],
        "k long, row int, step long, tokens array<long>",
    )
    out = to.prefix_reuse(seqs, ["k"], row="row").orderBy("step").collect()
    assert [(r.reused, r.new) for r in out] == [(0, 3), (1, 2)]


@pytest.mark.parametrize("group", [1, None])
@pytest.mark.parametrize("side", ["left", "right"])
def test_pad(spark, side, group):
    rows = spark.range(20).select(
        F.col("id"), F.lit(group).cast("int").alias("g"),
        F.array_repeat(F.lit(5).cast("long"), F.col("id").cast("int")).alias("t"),
    )
    out = to.pad_to_longest(rows, ["g"], "t", 0, side)
    for r in out.collect():
        own, fill = [5] * r.id, [0] * (19 - r.id)
        assert r.t == (fill + own if side == "left" else own + fill)


def test_bad_side():
    with pytest.raises(ValueError, match="side"):
        ar.pad_to(None, None, 0, "middle")


def test_bans_allow_blanks(spark):
    candidates = spark.range(6).select(F.lit(1).alias("k"), F.col("id").alias("c"))
    requests = spark.createDataFrame(
        [(1, " 1, 3 ,99", True)], "k int, ban_csv string, ban_end boolean"
    )
    out = to.apply_bans(candidates, requests, ["k"], "c", end_id=5)
    assert sorted(r.c for r in out.collect()) == [0, 2, 4]


@pytest.mark.parametrize("group", [1, None])
def test_mask_finished_rows(spark, group):
    rows = spark.createDataFrame(
        [(group, p, t) for p, t in enumerate([4, 9, 5, 9, 6])] + [(2, 0, 4), (2, 1, 4)],
        "s long, pos long, token long",
    )
    out = to.mask_finished(rows, ["s"], [9], 0).orderBy("s", "pos")
    assert [r.token for r in out.collect()] == [4, 9, 0, 0, 0, 4, 4]


@pytest.mark.parametrize("group", [1, None])
def test_leader_of_a_group(spark, group):
    rows = spark.range(100).select(
        F.lit(group).cast("int").alias("g"), "id", (F.col("id") * 2).alias("v")
    )
    out = to.leader_value(rows, ["g"], "id", "v").collect()
    assert len(out) == 100 and {r.v for r in out} == {0}


def test_prefix_reuse_over_a_gap_in_steps(spark):
    rows = spark.createDataFrame(
        [(1, 0, [1, 2, 3]), (1, 2, [1, 2, 3, 4])], "k long, step int, tokens array<long>"
    )
    got = {r.step: (r.reused, r.new) for r in to.prefix_reuse(rows, ["k"]).collect()}
    assert got == {0: (0, 3), 2: (3, 1)}
