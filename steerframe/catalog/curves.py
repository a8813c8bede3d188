"""Curve, profile and layer-numbering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steerframe.catalog.common import mod, pick, rounded, table
from steerframe.functions import curves as cv
from steerframe.operators import curves as co

POINTS = [(0.0, 0.0), (0.05, 1.0), (0.30, 1.0), (0.35, 0.0), (0.35, 0.5), (1.0, 0.75)]


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_size") / 50).alias("depth"),
        pick(mod("p_partkey", 3), "interpolate", "ceil", "floor").alias("mode"),
    )
    out = co.curve_at(parts, cv.curve_literal(POINTS), F.col("mode"), F.col("depth"))
    return out.select("p_partkey", "mode", rounded(F.col("ratio")).alias("ratio"))


SQL_CURVE = """
WITH p(ord, depth, ratio) AS (
  VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.05, 1.0), (2, 0.30, 1.0),
         (3, 0.35, 0.0), (4, 0.35, 0.5), (5, 1.0, 0.75)
),
s AS (
  SELECT a.ord, a.depth AS d1, a.ratio AS r1, b.depth AS d2, b.ratio AS r2
  FROM p a JOIN p b ON b.ord = a.ord + 1
),
x AS (
  SELECT p_partkey, p_size / 50 AS depth,
         ['interpolate', 'ceil', 'floor'][p_partkey % 3 + 1] AS mode
  FROM part
),
f AS (
  SELECT x.*, s.* FROM x JOIN s ON x.depth BETWEEN s.d1 AND s.d2
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s.ord) = 1
)
SELECT x.p_partkey, x.mode,
  round(CASE
    WHEN x.depth <= 0 THEN 0 WHEN x.depth >= 1 THEN 0.75
    WHEN x.mode = 'ceil' OR f.d1 = f.d2 THEN greatest(f.r1, f.r2)
    WHEN x.mode = 'floor' THEN least(f.r1, f.r2)
    ELSE f.r1 + (x.depth - f.d1) / (f.d2 - f.d1) * (f.r2 - f.r1) END, 6) + 0.0 AS ratio
FROM x LEFT JOIN f USING (p_partkey)"""


def _is_on(bit: int):
    """Whether a customer's profile numbered ``bit`` is switched on."""
    return F.floor(F.col("c_custkey") / (2**bit)) % 2 == 1


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the profiles switched on by the bits of its key."""
    slots = F.array(
        *[
            F.when(_is_on(i), cv.profile_literal(name, F.lit(i)))
            for i, name in enumerate(cv.PROFILES)
        ]
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_compact(slots).alias("selected")
    )


def _merged(spark: SparkSession, sf_dir: str, drop_joint: bool) -> DataFrame:
    merged = co.merge_profiles(customer_profiles(spark, sf_dir), drop_joint=drop_joint)
    return merged.select(
        "c_custkey",
        "mode",
        F.size("shape").cast("long").alias("frames"),
        F.array_join(
            F.transform(
                "shape",
                lambda p: F.concat_ws(
                    "=",
                    F.round(p["depth"] * 100).cast("int").cast("string"),
                    p["ratio"].cast("int").cast("string"),
                ),
            ),
            " ",
        ).alias("curve"),
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


def merged_without_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, True)


def _sql_merged(drop_joint: bool) -> str:
    # A profile's skip_before frame goes if its lower sibling is selected too: each
    # profile keeps at least one frame, so the last kept frame came from that sibling.
    skip_after = "OR (f.skip_after AND list_contains(s.sel, f.sib + 1))" if drop_joint else ""
    return f"""
WITH f(sib, ord, mode, depth, ratio, skip_before, skip_after) AS (
  VALUES (0, 0, 'ceil', 1, 1, false, false), (0, 1, 'ceil', 5, 0, false, true),
         (1, 0, 'interpolate', 0, 0, true, false), (1, 1, 'interpolate', 5, 1, false, false),
         (1, 2, 'interpolate', 30, 1, false, false), (1, 3, 'interpolate', 35, 0, false, true),
         (2, 0, 'interpolate', 30, 0, true, false), (2, 1, 'interpolate', 35, 1, false, false),
         (2, 2, 'interpolate', 60, 1, false, false), (2, 3, 'interpolate', 65, 0, false, true),
         (3, 0, 'interpolate', 60, 0, true, false), (3, 1, 'interpolate', 65, 1, false, false),
         (3, 2, 'interpolate', 95, 1, false, false), (3, 3, 'interpolate', 100, 0, false, true),
         (4, 0, 'ceil', 99, 0, true, false), (4, 1, 'ceil', 100, 1, false, false)
),
s AS (
  SELECT c_custkey, list_filter([0, 1, 2, 3, 4], lambda b: (c_custkey >> b) & 1 = 1) AS sel
  FROM customer
),
k AS (
  SELECT s.c_custkey, f.* FROM s JOIN f ON list_contains(s.sel, f.sib)
  WHERE NOT (f.skip_before AND (f.sib = 0 OR list_contains(s.sel, f.sib - 1)) {skip_after})
),
g AS (
  SELECT c_custkey, count(*) AS frames,
         string_agg(depth || '=' || ratio, ' ' ORDER BY sib, ord) AS curve
  FROM k GROUP BY 1
)
SELECT s.c_custkey,
       CASE WHEN list_has_any(s.sel, [1, 2, 3]) THEN 'interpolate' ELSE 'ceil' END AS mode,
       coalesce(frames, 0) AS frames, coalesce(curve, '') AS curve
FROM s LEFT JOIN g USING (c_custkey)"""


def site_curves(spark: SparkSession) -> DataFrame:
    """One curve per dosed site: an empty one, single profiles and merged ones."""
    chosen = {"a_ho": [], "v_all": ["input_noise"], "k_all": ["early_noise", "mid_noise"],
              "q_in": ["output_noise"], "h": ["late_noise"]}
    order = list(cv.PROFILES)
    rows = [(site, order.index(p), p) for site, ps in chosen.items() for p in ps]
    selected = spark.createDataFrame(rows, "site string, sib_ord int, name string")
    sites = spark.createDataFrame([(s,) for s in chosen], "site string")
    merged_curves = co.merge_selected(selected, ["site"])
    return sites.join(merged_curves, "site", "left").withColumn("dose", F.lit(cv.DEFAULT_DOSE))


def dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "part").select(
        "p_partkey",
        pick(mod("p_partkey", 6), "a_ho", "v_all", "k_all", "q_in", "h", "no_curve").alias("site"),
        F.col("p_size").alias("block_idx"),
        F.lit(50).alias("total_blocks"),
    )
    out = co.shaped_dose(blocks, site_curves(spark), ["site"])
    return out.select("p_partkey", "site", rounded(F.col("shaped_dose")).alias("shaped_dose"))


SQL_DOSE = """
WITH p AS (
  SELECT p_partkey, p_size / 50 AS d,
         ['a_ho', 'v_all', 'k_all', 'q_in', 'h', 'no_curve'][p_partkey % 6 + 1] AS site
  FROM part
)
SELECT p_partkey, site, round(0.1 * CASE site
  WHEN 'v_all' THEN CASE WHEN d < 0.05 THEN 1 ELSE 0 END
  WHEN 'k_all' THEN CASE WHEN d <= 0.05 THEN d / 0.05 WHEN d <= 0.30 THEN 1
    WHEN d < 0.35 THEN (0.35 - d) / 0.05 WHEN d = 0.35 THEN 0 WHEN d <= 0.60 THEN 1
    WHEN d <= 0.65 THEN (0.65 - d) / 0.05 ELSE 0 END
  WHEN 'q_in' THEN CASE WHEN d > 0.99 THEN 1 ELSE 0 END
  WHEN 'h' THEN CASE WHEN d <= 0.60 THEN 0 WHEN d <= 0.65 THEN (d - 0.60) / 0.05
    WHEN d <= 0.95 THEN 1 ELSE (1 - d) / 0.05 END
  ELSE 0 END, 6) + 0.0 AS shaped_dose
FROM p"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = (mod("c_custkey", 5) + 6).cast("int")
    layers = F.filter(
        F.sequence(F.lit(0), count - 1), lambda i: (i + F.col("c_custkey")) % 3 != 0
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", count.alias("layer_count"), layers.alias("attn_layers")
    )


def attn_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = co.attn_to_layer(_models(spark, sf_dir).drop("layer_count"))
    return out.select(
        "c_custkey",
        F.col("attn_idx").cast("long").alias("attn_idx"),
        F.col("layer_idx").cast("long").alias("layer_idx"),
    )


def layer_attn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = co.layer_to_attn(_models(spark, sf_dir))
    return out.select(
        "c_custkey",
        F.col("layer_idx").cast("long").alias("layer_idx"),
        F.col("attn_idx").cast("long").alias("attn_idx"),
    )


_SQL_LAYERS = """
WITH l AS (
  SELECT c_custkey, unnest(range(c_custkey % 5 + 6)) AS layer_idx FROM customer
),
a AS (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY layer_idx) - 1 AS attn_idx
  FROM l WHERE (layer_idx + c_custkey) % 3 <> 0
)
"""
SQL_ATTN_LAYERS = _SQL_LAYERS + "SELECT c_custkey, attn_idx, layer_idx FROM a"
SQL_LAYER_ATTN = (
    _SQL_LAYERS
    + "SELECT l.c_custkey, l.layer_idx, a.attn_idx FROM l LEFT JOIN a USING (c_custkey, layer_idx)"
)


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for models, their events for layers; blocks of 500 event ids."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = co.block_ordinal(
        rows, ["user_id"], "event_id", F.col("event_type").isin("click", "purchase"), block=500
    )
    return out.select(
        "user_id",
        "event_id",
        F.col("block_idx").cast("long").alias("block_idx"),
        F.col("total_blocks").cast("long").alias("total_blocks"),
    )


SQL_ORDINALS = """
SELECT user_id, event_id,
  coalesce(count(*) FILTER (event_type IN ('click', 'purchase')) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), 0) AS block_idx,
  count(*) FILTER (event_type IN ('click', 'purchase')) OVER (PARTITION BY user_id)
    AS total_blocks
FROM events"""


QUERIES = {
    "curve_at": curve,
    "merge_profiles": merged,
    "merge_profiles_drop_joint": merged_without_joints,
    "shaped_dose": dose,
    "index_map_attn_to_layer": attn_layers,
    "index_map_layer_to_attn": layer_attn,
    "block_ordinal": ordinals,
}

ORACLES = {
    "curve_at": SQL_CURVE,
    "merge_profiles": _sql_merged(False),
    "merge_profiles_drop_joint": _sql_merged(True),
    "shaped_dose": SQL_DOSE,
    "index_map_attn_to_layer": SQL_ATTN_LAYERS,
    "index_map_layer_to_attn": SQL_LAYER_ATTN,
    "block_ordinal": SQL_ORDINALS,
}
