import json

import pytest
from pyspark.sql import functions as F

from steerframe.functions import curves as cv
from steerframe.operators import curves as co
from steerframe.operators.running import running_sum

RAMP = [(0.0, 0.0), (0.05, 1.0), (0.30, 1.0), (0.35, 0.0)]
DROP = [(0.01, 1.0), (0.05, 0.0)]


def ratio(spark, points, mode, depth):
    curve = cv.curve_literal(points) if points else F.array().cast(
        "array<struct<depth:double,ratio:double,skip_before:boolean,skip_after:boolean>>"
    )
    return spark.range(1).select(
        cv.value_at(curve, F.lit(mode), F.lit(depth)).alias("x")
    ).first().x


@pytest.mark.parametrize(
    "points,mode,depth,expected",
    [
        (RAMP, "interpolate", 0.025, 0.5),
        (RAMP, "ceil", 0.025, 1.0),
        (RAMP, "floor", 0.025, 0.0),
        (RAMP, "interpolate", 0.2, 1.0),
        (RAMP, "interpolate", 0.9, 0.0),
        (RAMP, "interpolate", 0.05, 1.0),
        (DROP, "ceil", 0.0, 1.0),
        (DROP, "ceil", 0.03, 1.0),
        (DROP, "ceil", 0.05, 0.0),
        (DROP, "ceil", 1.0, 0.0),
        ([(0.5, 0.25)], "interpolate", 0.7, 0.25),
        ([(0.0, 0.0), (0.5, 2.0), (0.5, 4.0), (1.0, 0.0)], "floor", 0.5, 0.0),
        ([], "ceil", 0.5, None),
    ],
)
def test_value_at(spark, points, mode, depth, expected):
    assert ratio(spark, points, mode, depth) == (
        None if expected is None else pytest.approx(expected)
    )


def merged(spark, names, drop_joint=False):
    order = list(cv.PROFILES)
    df = spark.createDataFrame(
        [(1, order.index(n), n) for n in names], "k long, sib_ord int, name string"
    )
    row = co.merge_selected(df, ["k"], drop_joint).first()
    return row.mode, [(p.depth, p.ratio) for p in row["shape"]]


def test_merge_keeps_joint_frame_by_default(spark):
    mode, frames = merged(spark, ["early_noise", "mid_noise"])
    assert mode == "interpolate"
    assert frames == [
        (0.00, 0.0), (0.05, 1.0), (0.30, 1.0), (0.35, 0.0), (0.35, 1.0), (0.60, 1.0), (0.65, 0.0),
    ]


def test_merge_can_drop_joint_frame(spark):
    _, frames = merged(spark, ["early_noise", "mid_noise"], drop_joint=True)
    assert (0.35, 0.0) not in frames and (0.35, 1.0) in frames


def test_slots_keep_written_order(spark):
    def slot(on):
        return {"attributes": {"label": "x", "value": on}}

    names = {"zz": slot(False), "mid_noise": slot(True), "early_noise": slot(True)}
    tree = {"h": {"sub_attr": {"box": {"sub_attr": names}}}, "q_in": {"sub_attr": {}}}
    df = spark.createDataFrame([("o", json.dumps(tree)), ("p", "{}")], "owner string, t string")
    slots = co.profile_slots(df, "t", ["owner"], "box")
    assert [(r.owner, r.site, r.sib_ord, r.name, r.selected) for r in slots.collect()] == [
        ("o", "h", 0, "zz", False),
        ("o", "h", 1, "mid_noise", True),
        ("o", "h", 2, "early_noise", True),
    ]
    assert co.selected_profiles(slots).columns == ["owner", "site", "sib_ord", "name"]


def test_first_sibling_counts_as_following_one(spark):
    df = spark.range(1).select(
        F.array(
            F.struct(
                F.lit(0).alias("sib_ord"), F.lit("x").alias("name"), F.lit("ceil").alias("mode"),
                cv.profile_literal("early_noise", F.lit(0))["shape"].alias("shape"),
            )
        ).alias("selected")
    )
    shape = co.merge_profiles(df).first()["shape"]
    assert [p.depth for p in shape] == [0.05, 0.30, 0.35]


def test_nothing_selected(spark):
    df = spark.range(1).select(
        F.array().cast(
            "array<struct<sib_ord:int,name:string,mode:string,"
            "shape:array<struct<depth:double,ratio:double,skip_before:boolean,"
            "skip_after:boolean>>>>"
        ).alias("selected")
    )
    row = co.merge_profiles(df).first()
    assert row.mode == "ceil" and row["shape"] == []


def test_dose_without_curve_is_zero(spark):
    blocks = spark.createDataFrame(
        [("h", 1, 10), ("q_in", 1, 10)], "site string, block_idx int, total_blocks int"
    )
    curves = spark.range(1).select(
        F.lit("h").alias("site"), F.lit("ceil").alias("mode"),
        cv.curve_literal([(0.0, 2.0), (1.0, 2.0)]).alias("shape"), F.lit(0.1).alias("dose"),
    )
    out = co.shaped_dose(blocks, curves, ["site"])
    assert {r.site: r.shaped_dose for r in out.collect()} == {"h": pytest.approx(0.2), "q_in": 0.0}


def test_index_maps(spark):
    df = spark.createDataFrame(
        [(1, 5, [1, 3, 1]), (2, 0, [])], "m long, layer_count int, attn_layers array<int>"
    )
    to_layer = co.attn_to_layer(df.drop("layer_count")).orderBy("attn_idx").collect()
    assert [(r.attn_idx, r.layer_idx) for r in to_layer] == [(0, 1), (1, 3), (2, 1)]
    to_attn = co.layer_to_attn(df).orderBy("layer_idx").collect()
    assert [r.attn_idx for r in to_attn] == [None, 2, None, 1, None]


@pytest.mark.parametrize("block", [1, 7, 1000])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_sum_in_blocks(spark, block, exclusive):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    out = running_sum(
        df, ["g"], "id", F.col("id"), "run", exclusive=exclusive, total="all", block=block
    )
    totals = {}
    for r in out.orderBy("id").collect():
        before = totals.get(r.g, 0)
        totals[r.g] = before + r.id
        assert r.run == (before if exclusive else totals[r.g])
        assert r.all == sum(range(r.g, 100, 3))
