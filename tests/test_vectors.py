import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steerframe.functions import noise as ns, vectors as vx
from steerframe.operators import dispatch as dp, lookup, vectors as vo
from steerframe.operators.lookup import weighted_lookup

VECTORS = "group_id long, batch_idx int, numpos int, numneg int, vec array<double>"


def random_vectors(spark, n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(
        [(i, rng.normal(size=dim).tolist()) for i in range(n)], "id long, vec array<double>"
    )


@pytest.mark.parametrize("dim", [2, None])
@pytest.mark.parametrize("group", [2, None])
def test_steer_golden(spark, group, dim):
    rows = [(group, i, 1, 2, v) for i, v in enumerate([[2.0, 0.0], [4.0, 2.0], [0.0, 4.0]])]
    rows += [(1, 0, 1, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    out = vo.steer_from_negatives(df, ["group_id"], 0.5, dim=dim)
    got = {(r.group_id, r.batch_idx): r.vec for r in out.collect()}
    assert got == {
        (group, 0): [2.0, -1.5], (group, 1): [4.0, 0.5], (group, 2): [0.0, 2.5],
        (1, 0): [1.0, 1.0],
    }


def test_steer_with_no_negatives_at_all(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, [1.0, 2.0])], VECTORS)
    assert vo.steer_from_negatives(df, ["group_id"]).first().vec == [1.0, 2.0]


@pytest.mark.parametrize("lost", [0, 2])
def test_steer_leaves_incomplete_groups(spark, lost):
    vectors = [[2.0, 0.0], [4.0, 2.0], [0.0, 4.0]]
    rows = [(1, i, 1, 2, v) for i, v in enumerate(vectors) if i != lost]
    out = vo.steer_from_negatives(spark.createDataFrame(rows, VECTORS), ["group_id"], dim=2)
    assert {r.batch_idx: r.vec for r in out.collect()} == {r[1]: r[4] for r in rows}


def test_steer_fails_on_another_length(spark):
    rows = [(1, i, 1, 1, [1.0, 2.0, float(i)]) for i in range(2)]
    df = spark.createDataFrame(rows, VECTORS)
    with pytest.raises(Exception, match="not 2 long"):
        vo.steer_from_negatives(df, ["group_id"], dim=2).collect()


@pytest.mark.parametrize("noise", [ns.HASHED, ns.ARITHMETIC])
def test_rotation_keeps_length_and_bounds_angle(spark, noise):
    df = random_vectors(spark, 400, 24)
    out = vo.rotate_random(df, 0.3, F.col("id"), 7, out="turned", noise=noise)
    rows = out.select(
        (vx.norm(F.col("turned")) / vx.norm(F.col("vec"))).alias("ratio"),
        vx.angle(F.col("vec"), F.col("turned")).alias("angle"),
    ).collect()
    assert max(abs(r.ratio - 1) for r in rows) < 1e-11
    assert max(r.angle for r in rows) < 0.3 + 1e-6
    audit = vo.angle_audit(out, "vec", "turned", 0.3).first()
    assert abs(audit.ratio - 1) < 0.15


def test_rotation_by_zero_is_identity(spark):
    out = vo.rotate_random(random_vectors(spark, 50, 8), 0.0, F.col("id"), 1, out="t")
    for r in out.collect():
        assert r.t == pytest.approx(r.vec, abs=1e-15)


def test_rotation_does_not_depend_on_partitions(spark):
    df = random_vectors(spark, 100, 8)
    one = vo.rotate_random(df.coalesce(1), 0.3, F.col("id"), 1)
    many = vo.rotate_random(df.repartition(7), 0.3, F.col("id"), 1)
    assert sorted(one.collect()) == sorted(many.collect())


@pytest.mark.parametrize("vec", [[0.0, 0.0, 0.0], [3.0], [-2.0]])
def test_degenerate_vectors_stay(spark, vec):
    df = spark.createDataFrame([(1, vec)], "id long, vec array<double>")
    assert vo.rotate_random(df, 0.5, F.col("id"), 1).first().vec == vec


def test_rotation_of_mixed_lengths_and_nulls(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 2.0, 0.0]), (3, []), (4, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    got = {r.id: r.vec for r in vo.rotate_random(df, 0.5, F.col("id"), 1).collect()}
    assert got[1] is None and got[3] == []
    for i in (0, 2, 4):
        assert math.hypot(*got[i]) == pytest.approx(math.hypot(*rows[i][1]))
        assert got[i] != rows[i][1]


@pytest.mark.parametrize("noise", [ns.HASHED, ns.ARITHMETIC])
def test_noise_is_uniform(noise):
    drawn = noise.block(np.arange(5000), 8, 3)
    assert 0 <= drawn.min() and drawn.max() < 1
    np.testing.assert_allclose(drawn.mean(axis=0), 0.5, atol=0.03)


@pytest.mark.parametrize(
    "site,past,chunk,protect,expected",
    [
        ("h", 0, 10, False, range(6, 10)),
        ("h", 0, 10, True, []),
        ("h", 8, 1, True, [0]),
        ("q_in", 8, 4, True, [0]),
        ("a_ho", 2, 9, False, range(4, 9)),
        ("k_all", 8, 1, True, [6, 7]),
        ("k_all", 8, 1, False, range(6, 9)),
        ("v_all", 4, 3, False, range(2, 7)),
    ],
)
def test_span(spark, site, past, chunk, protect, expected):
    df = spark.range(12).select(
        F.lit(site).alias("site"), F.col("id").alias("pos"), F.lit(past).alias("past_len"),
        F.lit(chunk).alias("chunk_len"), F.lit(protect).alias("protect"),
    )
    flagged = vo.select_span(df).filter("in_span").collect()
    assert sorted(r.pos for r in flagged) == list(expected)


@pytest.mark.parametrize("group", [1, None])
def test_softmax_of_extreme_scores(spark, group):
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.lit(group).cast("int")).alias("g"), "id",
        F.when(F.col("id") % 2 == 0, 5000.0 - F.col("id")).otherwise(-5000.0 + F.col("id") * 40)
        .alias("s"),
    )
    out = vo.group_softmax(df, ["g"], "s")
    sums = {r.g: r.total for r in out.groupBy("g").agg(F.sum("weight").alias("total")).collect()}
    assert sums == pytest.approx({0: 1.0, group: 1.0}, abs=1e-12)


def test_draw_follows_softmax(spark):
    scores = [0.0, 1.0, 2.0]
    df = spark.range(20_000).select(
        F.col("id").alias("g"), F.posexplode(F.array(*map(F.lit, scores))).alias("c", "s")
    )
    out = vo.weighted_draw(df, ["g"], "c", "s", 3)
    counts = {r.c: r["count"] / 20_000 for r in out.groupBy("c").count().collect()}
    total = sum(map(math.exp, scores))
    for i, s in enumerate(scores):
        assert counts[i] == pytest.approx(math.exp(s) / total, abs=0.012)
    assert sorted(out.collect()) == sorted(
        vo.weighted_draw(df.repartition(5), ["g"], "c", "s", 3).collect()
    )


def _attention(q, k, v, visible):
    scores = np.where(visible, q @ k.T / math.sqrt(q.shape[1]), -np.inf)
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True) @ v


@pytest.mark.parametrize("tile", [1, 1024])
@pytest.mark.parametrize(
    "window,causal", [(1, True), (5, True), (16, True), (100, True), (7, False), (1, False)]
)
def test_lookup_against_dense(spark, monkeypatch, window, causal, tile):
    monkeypatch.setattr(lookup, "MIN_TILE", tile)
    n, rng = 61, np.random.default_rng(2)
    q, k, v = (rng.normal(size=(n, 4)) for _ in range(3))
    queries = spark.createDataFrame(
        [(1, 0, i, q[i].tolist()) for i in range(n)],
        "g long, head int, pos long, vec array<double>",
    )
    keys = spark.createDataFrame(
        [(1, 0, i, k[i].tolist(), v[i].tolist()) for i in range(n)],
        "g long, head int, pos long, key array<double>, value array<double>",
    )
    out = weighted_lookup(queries, keys, ["g"], window, causal=causal).orderBy("pos").collect()
    gap = np.subtract.outer(np.arange(n), np.arange(n))
    visible = (gap >= 0) & (gap < window) if causal else np.abs(gap) < window
    np.testing.assert_allclose(
        np.array([r.out for r in out]), _attention(q, k, v, visible), atol=1e-12
    )


@pytest.mark.parametrize("tile", [7, 4096])
@pytest.mark.parametrize("causal", [True, False])
@pytest.mark.parametrize("dim", [4, None])
def test_unbounded_lookup_against_dense(spark, tile, causal, dim):
    """Large scores of either sign, so that the states of a query have several bases."""
    n, rng = 61, np.random.default_rng(2)
    q, k, v = (rng.normal(size=(n, 4)) for _ in range(3))
    q *= 60
    rows = {"a": range(n), None: range(0, n, 2)}
    queries = spark.createDataFrame(
        [(g, h, i, q[i].tolist()) for g, own in rows.items() for h in (0, 1) for i in own],
        "g string, head int, pos long, vec array<double>",
    ).repartition(5)
    keys = spark.createDataFrame(
        [(g, 0, i, k[i].tolist(), v[i].tolist()) for g, own in rows.items() for i in own],
        "g string, head int, pos long, key array<double>, value array<double>",
    )
    bias = F.when(F.col("pos") % 5 == 0, float("-inf")).otherwise(0.0)
    out = weighted_lookup(
        queries, keys, ["g"], heads_per_key=2, causal=causal, bias=bias, tile=tile, dim=dim
    )
    got = {(r.g, r.head, r.pos): r.out for r in out.collect()}
    assert len(got) == queries.count()
    for g, own in rows.items():
        own = np.array(own)
        visible = np.ones((len(own), 1)) * (own % 5 > 0)
        if causal:
            visible = visible * (own[:, None] >= own[None, :])
        for h in (0, 1):
            for at, i in enumerate(own):
                if not visible[at].any():
                    assert got[g, h, i] is None
                    continue
                want = _attention(q[own][at : at + 1], k[own], v[own], visible[at : at + 1] > 0)
                np.testing.assert_allclose(got[g, h, i], want[0], atol=1e-9)


def test_unbounded_lookup_sees_two_tiles_at_a_time(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    queries = spark.range(600).select(
        F.lit(None).cast("int").alias("g"), F.lit(0).alias("head"), F.col("id").alias("pos"),
        F.array(F.lit(1.0)).alias("vec"),
    )
    keys = queries.select("g", "head", "pos", F.col("vec").alias("key"), F.col("vec").alias("value"))
    inner = lookup._cell_states

    def watched(names, causal):
        work = inner(names, causal)

        def states(q, k):
            if len(q) > 50 or len(k) > 50:
                sizes.add(1)
            return work(q, k)

        return states

    monkeypatch.setattr(lookup, "_cell_states", watched)
    out = weighted_lookup(queries, keys, ["g"], tile=50, dim=1)
    assert out.filter(F.abs(F.col("out")[0] - 1.0) < 1e-9).count() == 600
    assert sizes.value == 0


def test_unbounded_lookup_makes_few_stretches_of_many_tiles(spark):
    """A row meets as many cells as its group has stretches, however many tiles there are."""
    tiles = spark.createDataFrame(
        [(g, t * 10**9) for g, n in ((None, 1000), ("a", 17), ("b", 3)) for t in range(n)],
        "g string, _tile long",
    )
    placed = lookup._with_stretches(tiles, ["g"], 2).collect()
    for g, n in ((None, 16), ("a", 9), ("b", 3)):
        own = [s for _, s in sorted((r._tile, r._stretch) for r in placed if r.g == g)]
        assert len(set(own)) == n and own == sorted(own)
    # a stretch is never longer than a task should hold
    wide = lookup._with_stretches(tiles, ["g"], lookup.STRETCH // 4).filter("g is null")
    assert wide.groupBy("_stretch").count().agg(F.max("count")).first()[0] == 4


@pytest.mark.parametrize("causal", [True, False])
def test_unbounded_lookup_over_stretches_against_dense(spark, causal):
    n, rng = 150, np.random.default_rng(3)
    q, k, v = (rng.normal(size=(n, 2)) for _ in range(3))
    queries = spark.createDataFrame(
        [(1, 0, i, q[i].tolist()) for i in range(n)], "g int, head int, pos long, vec array<double>"
    )
    keys = spark.createDataFrame(
        [(1, 0, i, k[i].tolist(), v[i].tolist()) for i in range(n)],
        "g int, head int, pos long, key array<double>, value array<double>",
    )
    out = weighted_lookup(queries, keys, ["g"], causal=causal, tile=2, dim=2).collect()
    visible = np.tril(np.ones((n, n))) > 0 if causal else np.ones((n, n)) > 0
    want = _attention(q, k, v, visible)
    assert len(out) == n
    for r in out:
        np.testing.assert_allclose(r.out, want[r.pos], atol=1e-9)


def test_only_steered_rows_are_shuffled(spark, tmp_path):
    """A default touches two layers: the vectors of all others stay where they were read."""
    rows = [(g, i, 1, 1, [float(g), i * 1.0], layer, "layer")
            for g in range(6) for i in range(2) for layer in range(4)]
    spark.createDataFrame(rows, VECTORS + ", layer_idx long, site string").write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    settings = [dp.Setting(1, "layer", "steer", 0.5), dp.Setting(2, "layer", "scale", 2.0)]
    out = dp.apply_settings(vectors, settings, ["group_id"], dim=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    union = plan[plan.index("Union"):]
    # the branch of the others, behind the one that joins: no exchange of rows in it
    others = union[union.rindex("Filter NOT"):] if "Filter NOT" in union else union
    assert "hashpartitioning" not in others
    got = {(r.group_id, r.batch_idx, r.layer_idx): r.vec for r in out.collect()}
    assert len(got) == len(rows)
    assert got[3, 1, 2] == [6.0, 2.0] and got[3, 1, 0] == [3.0, 1.0]
    assert got[3, 1, 1] == [3.0, 1.0 - 0.5 * (1.0 - 0.0)]


def test_lookup_with_no_visible_key(spark):
    queries = spark.createDataFrame(
        [(1, 0, 0, [1.0]), (2, 0, 5, [1.0]), (1, 0, 9, [1.0])],
        "g long, head int, pos long, vec array<double>",
    )
    keys = spark.createDataFrame(
        [(1, 0, 4, [1.0], [3.0])],
        "g long, head int, pos long, key array<double>, value array<double>",
    )
    out = weighted_lookup(queries, keys, ["g"], 6).collect()
    assert {(r.g, r.pos): r.out for r in out} == {(1, 0): None, (2, 5): None, (1, 9): [3.0]}


def test_split_and_concat_are_inverse(spark):
    df = random_vectors(spark, 20, 12)
    heads = vo.split_vec(df, 3)
    assert heads.count() == 60
    assert sorted(vo.concat_vec(heads, ["id"]).select("id", "vec").collect()) == sorted(
        df.collect()
    )


def test_mask_tail(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    row = df.select(vx.mask_tail(F.col("v"), 2).alias("a"), vx.mask_tail(F.col("v"), 0).alias("b"))
    assert row.first() == ([1.0, -65504.0, -65504.0], [1.0, 2.0, 3.0])


def test_xent_leaves_out_ignored_labels(spark):
    rows = spark.createDataFrame(
        [(1, 0, [0.0, 0.0], 0), (1, 1, [math.log(3.0), 0.0], -100), (1, 2, [9.0, 9.0], 0)],
        "s long, pos long, scores array<double>, label int",
    )
    got = vo.shifted_xent(rows, rows, ["s"]).first()
    assert got.n == 1 and got.loss == pytest.approx(-math.log(0.75))


@pytest.mark.parametrize("label", [2, -1])
def test_xent_fails_on_labels_outside_the_scores(spark, label):
    rows = spark.createDataFrame(
        [(1, 0, [0.0, 0.0], 0), (1, 1, [0.0, 0.0], label)],
        "s long, pos long, scores array<double>, label int",
    )
    with pytest.raises(Exception, match="label outside the scores"):
        vo.shifted_xent(rows, rows, ["s"]).collect()


def sited(spark):
    rows = [(g, b, 1, 1, [float(g), float(b)], g, "h") for g in range(4) for b in range(2)]
    return spark.createDataFrame(rows, VECTORS + ", layer_idx long, site string")


def test_settings_as_list_or_table(spark, monkeypatch):
    settings = [dp.Setting(1, "h", "scale", 3.0), dp.Setting(2, "h", "steer", 1.0)]
    vectors = sited(spark)
    as_list = dp.apply_settings(vectors, settings, ["group_id"]).collect()
    table = dp._as_frame(vectors, settings)
    assert sorted(dp.apply_settings(vectors, table, ["group_id"]).collect()) == sorted(as_list)
    monkeypatch.setattr(dp, "MAX_BROADCAST_SETTINGS", 1)
    for form in (settings, table):
        joined = dp.apply_settings(vectors, form, ["group_id"])
        assert sorted(joined.collect()) == sorted(as_list)
    got = {(r.group_id, r.batch_idx): r.vec for r in as_list}
    assert got[(1, 1)] == [3.0, 3.0] and got[(2, 1)] == [2.0, 0.0] and got[(3, 1)] == [3.0, 1.0]


def test_stack_applies_in_order(spark):
    settings = [dp.Setting(1, "h", "plus", 1.0, 1), dp.Setting(1, "h", "scale", 10.0, 0)]
    registry = {
        **dp.FUNCTIONS,
        "plus": dp.VectorFunction(lambda vec, w, _: F.transform(vec, lambda x: x + w)),
    }
    out = dp.apply_stack(sited(spark), settings, ["group_id"], registry).collect()
    got = {(r.group_id, r.batch_idx): r.vec for r in out}
    assert got[(1, 1)] == [11.0, 11.0] and got[(0, 1)] == [0.0, 1.0]


def test_user_function_as_pandas_udf(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def negated(vecs: pd.Series) -> pd.Series:
        return vecs.map(lambda v: -v)

    registry = {"negate": dp.VectorFunction(lambda vec, w, _: negated(vec))}
    out = dp.apply_settings(sited(spark), [dp.Setting(3, "h", "negate")], ["group_id"], registry)
    assert {(r.group_id, r.batch_idx): r.vec for r in out.collect()}[(3, 1)] == [-3.0, -1.0]


def test_masked_and_huge_scores(spark):
    rows = spark.createDataFrame(
        [(1, float("-inf")), (1, 0.0), (1, 0.0), (2, 1e30), (2, 1.0), (3, float("-inf"))],
        "g long, s double",
    )
    got = vo.group_softmax(rows, ["g"], "s").collect()
    assert sorted((r.g, r.weight) for r in got) == [
        (1, 0.0), (1, 0.5), (1, 0.5), (2, 0.0), (2, 1.0), (3, 0.0)
    ]
