"""From changed settings to the dose of every block."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steerframe.functions import curves as cv
from steerframe.operators.curves import merge_named, profile_slots, shaped_dose
from steerframe.operators.params import flatten_params, upsert, values_only
from steerframe.operators.skew import too_large_to_copy

# Where a site's tree keeps its dose and its profiles.
GLOBALS, DOSE, PROFILES_CONTAINER = "type_globals", "dose_theta", "shape_sliders"


def redose(
    trees: DataFrame, tree: str, updates: DataFrame, blocks: DataFrame, keys: list[str]
) -> DataFrame:
    """Apply updates to settings trees, rebuild each site's curve, look it up per block.

    Updates are names paths with a ``value`` and a ``ts``; one of a path that a tree does
    not have is ignored.
    """
    params = values_only(flatten_params(trees, tree, keys))
    current = upsert(params, updates, keys).filter(F.size("path") == 3)
    slots = (
        profile_slots(trees, tree, keys, PROFILES_CONTAINER)
        .withColumn("path", F.array("site", F.lit(PROFILES_CONTAINER), "name"))
        .select(*keys, "path", "sib_ord")
    )
    container, name = F.get("path", F.lit(1)), F.get("path", F.lit(2))
    is_on = (
        F.col("sib_ord").isNotNull() & (F.col("value") == "true") & name.isin(*cv.PROFILES)
    )
    is_dose = (container == GLOBALS) & (name == DOSE)
    # a path is there once, so a site's list is at most as long as the table of profiles
    per_site = (
        current.join(too_large_to_copy(slots), [*keys, "path"], "left")
        .groupBy(*keys, F.get("path", F.lit(0)).alias("site"))
        .agg(
            F.array_sort(
                F.collect_list(F.when(is_on, F.struct("sib_ord", name.alias("name"))))
            ).alias("_names"),
            F.max(F.when(is_dose, F.col("value").try_cast("double"))).alias("dose"),
        )
    )
    curves = merge_named(per_site, "_names").withColumn(
        "dose", F.coalesce(F.col("dose"), F.lit(cv.DEFAULT_DOSE))
    )
    return shaped_dose(blocks, too_large_to_copy(curves), [*keys, "site"])
