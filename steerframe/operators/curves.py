"""Curves, profiles and layer numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steerframe.functions import curves as cv
from steerframe.operators.running import BLOCK, running_sum
from steerframe.operators.skew import attach
from steerframe.schemas import require


def curve_at(
    df: DataFrame, shape: Column, mode: Column, depth: Column, out: str = "ratio"
) -> DataFrame:
    """Add the curve's ratio at a depth; the curve is a column or a literal."""
    return df.withColumn(out, cv.value_at(shape, mode, depth))


def shaped_dose(
    blocks: DataFrame,
    curves: DataFrame,
    keys: list[str],
    block_idx: str = "block_idx",
    total: str = "total_blocks",
    dose: str = "dose",
) -> DataFrame:
    """Base dose times the curve at block/total; 0 without a curve or with an empty one.

    ``curves`` holds one row per key: ``mode``, ``shape`` and the base dose.
    """
    require(blocks, [*keys, block_idx, total], "shaped_dose")
    require(curves, [*keys, "mode", "shape", dose], "shaped_dose")
    joined = attach(blocks, curves.select(*keys, "mode", "shape", dose), keys)
    depth = F.col(block_idx) / F.col(total)
    shaped = F.col(dose) * cv.value_at(F.col("shape"), F.col("mode"), depth)
    return joined.withColumn("shaped_dose", F.coalesce(shaped, F.lit(0.0))).drop(
        "mode", "shape", dose
    )


_SLOTS = "map<string,struct<attributes:struct<value:boolean>>>"


def profile_slots(
    df: DataFrame,
    tree: str,
    keys: list[str],
    container: str,
    sites: tuple[str, ...] = cv.DOSED_SITES,
) -> DataFrame:
    """All profiles of each site in the order the tree lists them, on or off.

    A site's siblings are read as one typed map, which keeps their written order, so
    they are numbered inside the row and not by a window.
    """
    require(df, [tree, *keys], "profile_slots")

    def slots(site: str) -> Column:
        siblings = F.from_json(
            F.get_json_object(tree, f"$.{site}.sub_attr.{container}.sub_attr"), _SLOTS
        )
        return F.coalesce(
            F.transform(
                F.map_entries(siblings),
                lambda e, i: F.struct(
                    F.lit(site).alias("site"),
                    i.alias("sib_ord"),
                    e["key"].alias("name"),
                    e["value"]["attributes"]["value"].alias("selected"),
                ),
            ),
            F.array().cast(
                "array<struct<site:string,sib_ord:int,name:string,selected:boolean>>"
            ),
        )

    listed = df.select(*keys, F.concat(*[slots(site) for site in sites]).alias("_slots"))
    return listed.select(*keys, F.inline_outer("_slots")).filter(F.col("site").isNotNull())


def selected_profiles(slots: DataFrame) -> DataFrame:
    """The profiles switched on, with their place among all siblings."""
    require(slots, ["site", "sib_ord", "name", "selected"], "selected_profiles")
    return slots.filter("selected").drop("selected")


def merge_profiles(
    df: DataFrame, selected: str = "selected", drop_joint: bool = False
) -> DataFrame:
    """Add ``mode`` and ``shape`` of the merged curve of an array of profiles."""
    require(df, [selected], "merge_profiles")
    return df.withColumn("_curve", cv.merge_profiles(F.col(selected), drop_joint)).select(
        "*", "_curve.mode", "_curve.shape"
    ).drop("_curve", selected)


def merge_selected(
    selected: DataFrame, keys: list[str], drop_joint: bool = False
) -> DataFrame:
    """``merge_profiles`` for one row per selected profile (``sib_ord``, ``name``).

    A key holds each named profile at most once, so its list is at most as long as the
    table of profiles.
    """
    require(selected, [*keys, "sib_ord", "name"], "merge_selected")
    listed = (
        selected.filter(F.col("name").isin(*cv.PROFILES))
        .groupBy(*keys, "name")
        .agg(F.min("sib_ord").alias("sib_ord"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("sib_ord", "name"))).alias("_names"))
    )
    return merge_named(listed, "_names", drop_joint)


def merge_named(df: DataFrame, names: str, drop_joint: bool = False) -> DataFrame:
    """``merge_profiles`` for an ordered array of ``sib_ord`` and ``name``."""
    require(df, [names], "merge_named")
    profiles = F.transform(names, lambda n: cv.profile_named(n["name"], n["sib_ord"]))
    return merge_profiles(df.withColumn("selected", profiles).drop(names), drop_joint=drop_joint)


def attn_to_layer(df: DataFrame, attn_layers: str = "attn_layers") -> DataFrame:
    """One row per attention index with its layer."""
    require(df, [attn_layers], "attn_to_layer")
    rest = [c for c in df.columns if c != attn_layers]
    return df.select(
        *rest, F.posexplode_outer(attn_layers).alias("attn_idx", "layer_idx")
    ).filter(F.col("attn_idx").isNotNull())


def layer_to_attn(
    df: DataFrame, layer_count: str = "layer_count", attn_layers: str = "attn_layers"
) -> DataFrame:
    """One row per layer with its attention index, null for other layers.

    A layer listed twice keeps its last index.
    """
    require(df, [layer_count, attn_layers], "layer_to_attn")
    rest = [c for c in df.columns if c not in (layer_count, attn_layers)]

    def attn_idx(layer: Column) -> Column:
        from_end = F.array_position(F.reverse(attn_layers), layer)
        return F.when(from_end > 0, F.size(attn_layers) - from_end)

    layers = F.filter(
        F.sequence(F.lit(0), F.col(layer_count).cast("int")), lambda i: i < F.col(layer_count)
    )
    pairs = F.transform(
        layers, lambda i: F.struct(i.alias("layer_idx"), attn_idx(i).cast("int").alias("attn_idx"))
    )
    return df.withColumn("_pairs", pairs).select(*rest, F.inline_outer("_pairs")).filter(
        F.col("layer_idx").isNotNull()
    )


def block_ordinal(
    layers: DataFrame, model: list[str], idx: str, flag: Column, block: int = BLOCK
) -> DataFrame:
    """How many flagged layers come before this one, and how many the model has."""
    require(layers, [*model, idx], "block_ordinal")
    return running_sum(
        layers,
        model,
        idx,
        F.when(flag, F.lit(1)).otherwise(F.lit(0)),
        "block_idx",
        exclusive=True,
        total="total_blocks",
        block=block,
    )
