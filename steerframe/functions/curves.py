"""Piecewise curves as arrays of points.

A curve is one value: a short list of points kept in the row that uses it. Looking
it up is an expression, not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steerframe.functions.core import last_of, let
from steerframe.schemas import CURVE_POINT

# Fixed values: (depth, ratio, skip_before, skip_after) of the named profiles, in
# sibling order.
PROFILES = {
    "input_noise": ("ceil", [(0.01, 1.0, False, False), (0.05, 0.0, False, True)]),
    "early_noise": (
        "interpolate",
        [
            (0.00, 0.0, True, False),
            (0.05, 1.0, False, False),
            (0.30, 1.0, False, False),
            (0.35, 0.0, False, True),
        ],
    ),
    "mid_noise": (
        "interpolate",
        [
            (0.30, 0.0, True, False),
            (0.35, 1.0, False, False),
            (0.60, 1.0, False, False),
            (0.65, 0.0, False, True),
        ],
    ),
    "late_noise": (
        "interpolate",
        [
            (0.60, 0.0, True, False),
            (0.65, 1.0, False, False),
            (0.95, 1.0, False, False),
            (1.00, 0.0, False, True),
        ],
    ),
    "output_noise": ("ceil", [(0.99, 0.0, True, False), (1.0, 1.0, False, False)]),
}

# The sites a profile can be selected for, and each site's base dose.
DOSED_SITES = ("a_ho", "v_all", "k_all", "q_in", "h")
DEFAULT_DOSE = 0.1


def _point(depth: float, ratio: float, skip_before: bool, skip_after: bool) -> Column:
    return F.struct(
        F.lit(depth).alias("depth"),
        F.lit(ratio).alias("ratio"),
        F.lit(skip_before).alias("skip_before"),
        F.lit(skip_after).alias("skip_after"),
    )


def curve_literal(points: list[tuple[float, float]]) -> Column:
    return F.array(*[_point(depth, ratio, False, False) for depth, ratio in points])


def profile_literal(name: str, sib_ord: Column) -> Column:
    mode, points = PROFILES[name]
    return F.struct(
        sib_ord.cast("int").alias("sib_ord"),
        F.lit(name).alias("name"),
        F.lit(mode).alias("mode"),
        F.array(*[_point(*p) for p in points]).alias("shape"),
    )


def profile_named(name: Column, sib_ord: Column) -> Column:
    """The profile of that name, null for an unknown one."""
    known = F.lit(None)
    for profile in PROFILES:
        known = F.when(name == profile, profile_literal(profile, sib_ord)).otherwise(known)
    return known


def value_at(shape: Column, mode: Column, depth: Column) -> Column:
    """Ratio of the curve at a depth; null for an empty curve.

    Clamped at both ends. Inside, the first segment in list order that holds the depth
    counts, both ends included; ``ceil`` and ``floor`` take its larger or smaller
    ratio, any other mode lies on the line between.
    """
    first, last = F.get(shape, F.lit(0)), last_of(shape)
    n = F.greatest(F.size(shape) - 1, F.lit(0))
    segments = F.zip_with(
        F.slice(shape, F.lit(1), n),
        F.slice(shape, F.lit(2), n),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    holding = F.get(
        F.filter(
            segments, lambda s: (s["a"]["depth"] <= depth) & (s["b"]["depth"] >= depth)
        ),
        F.lit(0),
    )

    def on_segment(s: Column) -> Column:
        a, b = s["a"], s["b"]
        along = F.try_divide(depth - a["depth"], b["depth"] - a["depth"])
        return (
            F.when(
                (mode == "ceil") | (a["depth"] == b["depth"]),
                F.greatest(a["ratio"], b["ratio"]),
            )
            .when(mode == "floor", F.least(a["ratio"], b["ratio"]))
            .otherwise(along * (b["ratio"] - a["ratio"]) + a["ratio"])
        )

    # points out of order may leave a depth in no segment: the ends then span it
    ends = F.struct(first.alias("a"), last.alias("b"))
    return (
        F.when(F.size(shape) == 0, F.lit(None).cast("double"))
        .when(depth <= first["depth"], first["ratio"])
        .when(depth >= last["depth"], last["ratio"])
        .otherwise(let(F.coalesce(holding, ends), on_segment))
    )


def merge_profiles(selected: Column, drop_joint: bool = False) -> Column:
    """One curve, ``struct<mode, shape>``, from an array of profiles in sibling order.

    A frame marked ``skip_before`` is dropped if the last kept frame came from the
    sibling just before (sibling 0 counts as having one). Frames marked ``skip_after``
    are kept, unless ``drop_joint`` asks to drop those whose next sibling is selected.
    """
    sib_ords = F.transform(selected, lambda p: p["sib_ord"])
    frames = F.flatten(
        F.transform(
            selected,
            lambda p: F.transform(
                p["shape"],
                lambda f: F.struct(p["sib_ord"].alias("sib"), f.alias("point")),
            ),
        )
    )

    def skipped(state: Column, frame: Column) -> Column:
        point = frame["point"]
        skip = F.coalesce(point["skip_before"], F.lit(False)) & (
            state["last_sib"] == frame["sib"] - 1
        )
        if drop_joint:
            skip = skip | (
                F.coalesce(point["skip_after"], F.lit(False))
                & F.array_contains(sib_ords, frame["sib"] + 1)
            )
        return skip

    def step(state: Column, frame: Column) -> Column:
        return F.when(skipped(state, frame), state).otherwise(
            F.struct(
                frame["sib"].alias("last_sib"),
                F.concat(state["kept"], F.array(frame["point"])).alias("kept"),
            )
        )

    start = F.struct(
        F.lit(-1).alias("last_sib"),
        F.array().cast(f"array<{CURVE_POINT.simpleString()}>").alias("kept"),
    )
    return F.struct(
        F.when(F.exists(selected, lambda p: p["mode"] == "interpolate"), F.lit("interpolate"))
        .otherwise(F.lit("ceil"))
        .alias("mode"),
        F.aggregate(frames, start, step, lambda state: state["kept"]).alias("shape"),
    )
