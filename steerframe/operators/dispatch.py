"""Settings dispatch: which transform runs at which layer and site."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from steerframe.functions import vectors as vx
from steerframe.operators.skew import attach
from steerframe.operators.vectors import steering_shift
from steerframe.schemas import SETTING, require
from steerframe.session import ensure_checkpoint_dir

# The sites of a layer that a setting can name, beside the layer's own
# output and the final scores.
SITES = (
    "attn_mask",
    "h",
    "h_post",
    "q_in",
    "q_in_post",
    "k_in",
    "k_all",
    "k_all_post",
    "v_in",
    "v_all",
    "v_all_post",
    "a_ho",
    "a_c",
    "a_po",
)
LAYER = "layer"
SCORES = "scores"

# Settings up to this many rows are held by the driver and broadcast; more of them
# are joined like any other table.
MAX_BROADCAST_SETTINGS = 20_000

DISPATCH_KEYS = ["layer_idx", "site"]


@dataclass(frozen=True)
class Setting:
    layer_idx: int
    site: str
    func: str | None
    weight: float = 0.0
    set_ord: int = 0


@dataclass(frozen=True)
class VectorFunction:
    """``apply(vec, weight, context)``; the context holds the row's columns by name.

    Any Column will do, so a pandas UDF over array batches can be plugged in here. A
    function with ``steers`` gets its group's ``shift`` in the context.
    """

    apply: Callable[[Column, Column, Mapping[str, Column]], Column]
    steers: bool = False


Registry = Mapping[str, VectorFunction]


def _steer(vec: Column, weight: Column, context: Mapping[str, Column]) -> Column:
    return F.when(context["shift"].isNull(), vec).otherwise(
        vx.subtract_scaled(vec, context["shift"], weight)
    )


FUNCTIONS: Registry = {
    "steer": VectorFunction(_steer, steers=True),
    "scale": VectorFunction(lambda vec, weight, _: vx.scale(vec, weight)),
    "mask_tail": VectorFunction(lambda vec, weight, _: vx.mask_tail(vec, weight.cast("int"))),
}


def default_settings(last_kv_layer: int, head_layer: int, weight: float, score_weight: float):
    """Steer around the last key/value layer and at the final scores."""
    return [
        Setting(last_kv_layer - 1, LAYER, "steer", weight),
        Setting(last_kv_layer + 1, LAYER, "steer", weight),
        Setting(head_layer, SCORES, "steer", score_weight),
    ]


def _bounded_list(settings: DataFrame) -> list[Setting] | None:
    """The settings as a list if they are few enough to hold, else None."""
    rows = settings.select(*SETTING.names).limit(MAX_BROADCAST_SETTINGS + 1).collect()
    if len(rows) > MAX_BROADCAST_SETTINGS:
        return None
    return [Setting(r.layer_idx, r.site, r.func, r.weight, r.set_ord) for r in rows]


def _as_frame(vectors: DataFrame, settings: list[Setting]) -> DataFrame:
    # of several settings for one key the last set holds, then the last in the list
    last = {
        tuple(getattr(s, name) for name in DISPATCH_KEYS): s
        for s in sorted(settings, key=lambda s: s.set_ord or 0)
    }
    rows = [{name: getattr(s, name) for name in SETTING.names} for s in last.values()]
    return vectors.sparkSession.createDataFrame(
        pa.Table.from_pylist(rows, schema=to_arrow_schema(SETTING))
    )


def _with_settings(vectors: DataFrame, settings: list[Setting] | DataFrame) -> DataFrame:
    if isinstance(settings, list):
        frame = _as_frame(vectors, settings).drop("set_ord")
        if len(settings) <= MAX_BROADCAST_SETTINGS:
            return vectors.join(F.broadcast(frame), DISPATCH_KEYS, "left")
    else:
        others = [c for c in settings.columns if c not in ("set_ord", *DISPATCH_KEYS)]
        order = [c for c in settings.columns if c == "set_ord"]
        frame = settings.groupBy(*DISPATCH_KEYS).agg(
            F.max(F.struct(*order, *others)).alias("_last")
        ).select(*DISPATCH_KEYS, *[F.col(f"_last.{c}").alias(c) for c in others])
    return attach(vectors, frame, DISPATCH_KEYS)


def _apply_one(
    vectors: DataFrame,
    settings: list[Setting] | DataFrame,
    group: list[str],
    registry: Registry,
    vec: str,
    batch_idx: str,
    dim: int | None,
) -> DataFrame:
    columns = vectors.columns
    rows = _with_settings(vectors, settings)
    steering = [name for name, f in registry.items() if f.steers]
    if isinstance(settings, list):
        used = {s.func for s in settings}
        steering = [name for name in steering if name in used]
    no_shift = F.lit(None).cast("array<double>")
    if steering:
        # only the rows that are steered are grouped and joined; all others stay where they are
        steers = F.coalesce(F.col("func").isin(*steering), F.lit(False))
        steered, others = rows.filter(steers), rows.filter(~steers)
        keys = [*DISPATCH_KEYS, *[g for g in group if g not in DISPATCH_KEYS]]
        shifts = steering_shift(steered, keys, batch_idx, vec=vec, dim=dim)
        rows = attach(steered, shifts, keys).unionByName(others.withColumn("shift", no_shift))
    else:
        rows = rows.withColumn("shift", no_shift)
    context = {c: F.col(c) for c in rows.columns}
    # no setting, or one that names no known function: the vector passes unchanged
    out = F.col(vec)
    for name, function in registry.items():
        out = F.when(
            F.col("func") == name, function.apply(F.col(vec), F.col("weight"), context)
        ).otherwise(out)
    return rows.withColumn(vec, out).select(*columns)


def apply_settings(
    vectors: DataFrame,
    settings: list[Setting] | DataFrame,
    group: list[str],
    registry: Registry = FUNCTIONS,
    vec: str = "vec",
    batch_idx: str = "batch_idx",
    dim: int | None = None,
) -> DataFrame:
    """Apply to each vector the transform set for its layer and site, if any."""
    require(vectors, [*DISPATCH_KEYS, *group, batch_idx, vec], "apply_settings")
    if isinstance(settings, DataFrame):
        require(settings, SETTING.names, "apply_settings")
        settings = _bounded_list(settings) or settings
    return _apply_one(vectors, settings, group, registry, vec, batch_idx, dim)


def apply_stack(
    vectors: DataFrame,
    settings: list[Setting] | DataFrame,
    group: list[str],
    registry: Registry = FUNCTIONS,
    vec: str = "vec",
    batch_idx: str = "batch_idx",
    dim: int | None = None,
) -> DataFrame:
    """Apply several setting sets in order, each to the output of the one before.

    A set that steers reads its input several times (for the group sums, for the rows it
    steers and for the others), so the vectors are checkpointed before it, if a set came
    before: the plan and the work grow with the number of sets, not exponentially.
    """
    require(vectors, [*DISPATCH_KEYS, *group, batch_idx, vec], "apply_stack")
    if isinstance(settings, DataFrame):
        require(settings, SETTING.names, "apply_stack")
        settings = _bounded_list(settings) or settings
    if isinstance(settings, list):
        ords = sorted({s.set_ord for s in settings})
        sets = [[s for s in settings if s.set_ord == o] for o in ords]
    else:
        ords = sorted(r.set_ord for r in settings.select("set_ord").distinct().collect())
        sets = [settings.filter(F.col("set_ord") == o) for o in ords]
    for i, one in enumerate(sets):
        may_steer = not isinstance(one, list) or any(
            s.func in registry and registry[s.func].steers for s in one
        )
        if i > 0 and may_steer:
            ensure_checkpoint_dir(vectors.sparkSession)
            vectors = vectors.checkpoint()
        vectors = _apply_one(vectors, one, group, registry, vec, batch_idx, dim)
    return vectors
