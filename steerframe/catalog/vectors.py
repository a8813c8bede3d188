"""Vector queries over ``embeddings``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steerframe.catalog.common import (
    SQL_COMPONENTS,
    components,
    div,
    mod,
    pick,
    rounded,
    table,
    vector_rows,
)
from steerframe.catalog.curves import site_curves
from steerframe.functions import noise as ns, vectors as vx
from steerframe.functions.blocks import with_values
from steerframe.operators import dispatch as dp, vectors as vo
from steerframe.operators.lookup import weighted_lookup
from steerframe.plans.noising import dose_vectors

DIM = 64
THETA = 0.4
SEED = 11


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of five rows: two positives, then three negatives in three groups of four."""
    group = div("vec_id", 5)
    return vector_rows(spark, sf_dir).select(
        group.alias("group_id"),
        mod("vec_id", 5).alias("batch_idx"),
        F.lit(2).alias("numpos"),
        F.when(group % 4 == 0, 0).otherwise(3).alias("numneg"),
        "vec",
    )


SQL_BATCHES = f"""
WITH {SQL_COMPONENTS},
b AS (
  SELECT vec_id // 5 AS group_id, vec_id % 5 AS batch_idx, i, x,
         CASE WHEN (vec_id // 5) % 4 = 0 THEN 0 ELSE 3 END AS numneg
  FROM c
)"""


def steer(spark: SparkSession, sf_dir: str) -> DataFrame:
    steered = vo.steer_from_negatives(batches(spark, sf_dir), ["group_id"], 0.3, dim=DIM)
    return components(steered, ["group_id", "batch_idx"])


SQL_STEER = (
    SQL_BATCHES
    + """,
neg AS (
  SELECT group_id, i, avg(x) AS mean FROM b
  WHERE batch_idx >= 2 AND batch_idx < 2 + numneg GROUP BY ALL
),
lead_row AS (SELECT group_id, i, x AS x0 FROM b WHERE batch_idx = 0)
SELECT b.group_id, b.batch_idx, b.i,
       round(b.x - coalesce(0.3 * (neg.mean - l.x0), 0), 6) + 0.0 AS value
FROM b JOIN lead_row l USING (group_id, i) LEFT JOIN neg USING (group_id, i)"""
)


def sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).withColumns(
        {
            "layer_idx": F.col("group_id") % 6,
            "site": pick(F.col("group_id") % 4, dp.LAYER, "h", "k_all", dp.SCORES),
        }
    )


SETTINGS = [
    dp.Setting(3, dp.SCORES, "steer", 0.3),
    dp.Setting(1, "h", "steer", 0.5),
    dp.Setting(3, "h", "scale", 0.5),
    dp.Setting(2, "k_all", "mask_tail", 4.0),
    dp.Setting(2, dp.LAYER, "no such function", 1.0),
    dp.Setting(5, "h", None, 1.0),
]

SQL_SITED = (
    SQL_BATCHES
    + """,
s AS (
  SELECT *, group_id % 6 AS layer_idx,
         ['layer', 'h', 'k_all', 'scores'][group_id % 4 + 1] AS site
  FROM b
),
shift AS (
  SELECT group_id, i,
         avg(x) FILTER (batch_idx >= 2 AND batch_idx < 2 + numneg)
           - max(x) FILTER (batch_idx = 0) AS d
  FROM s GROUP BY ALL
)"""
)


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dp.apply_settings(sited(spark, sf_dir), SETTINGS, ["group_id"], dim=DIM)
    return components(out, ["group_id", "batch_idx", "layer_idx", "site"])


SQL_DISPATCH = (
    SQL_SITED
    + """
SELECT group_id, batch_idx, layer_idx, site, i,
       round(CASE
         WHEN layer_idx = 3 AND site = 'scores' THEN x - coalesce(0.3 * d, 0)
         WHEN layer_idx = 1 AND site = 'h' THEN x - coalesce(0.5 * d, 0)
         WHEN layer_idx = 3 AND site = 'h' THEN x * 0.5
         WHEN layer_idx = 2 AND site = 'k_all' AND i >= 60 THEN -65504
         ELSE x END, 6) + 0.0 AS value
FROM s JOIN shift USING (group_id, i)"""
)


def _rectified(vec: Column, weight: Column, context: Mapping[str, Column]) -> Column:
    """A user's function over Arrow batches: negative components become zero."""

    @F.arrow_udf("array<double>")
    def rectify(vectors: pa.Array) -> pa.Array:
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        return with_values(vectors, np.maximum(values, 0.0))

    return rectify(vec)


def _clipped(vec: Column, weight: Column, context: Mapping[str, Column]) -> Column:
    """A user's function of columns: components within the weight, less for later rows."""
    bound = weight / (context["batch_idx"] + 1)
    return F.transform(vec, lambda x: F.greatest(F.least(x, bound), -bound))


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the user's beside the standard ones; unknown names change nothing."""
    registry = dp.FUNCTIONS | {
        "clip": dp.VectorFunction(_clipped),
        "rectify": dp.VectorFunction(_rectified),
    }
    settings = [
        dp.Setting(1, "h", "clip", 0.1), dp.Setting(2, "k_all", "rectify"),
        dp.Setting(3, "h", "no such", 1.0), dp.Setting(3, "scores", "scale", 2.0),
    ]
    out = dp.apply_settings(sited(spark, sf_dir), settings, ["group_id"], registry)
    return components(out, ["group_id", "batch_idx", "layer_idx", "site"])


SQL_USER_FUNCTIONS = (
    SQL_SITED
    + """
SELECT group_id, batch_idx, layer_idx, site, i,
       round(CASE
         WHEN layer_idx = 1 AND site = 'h'
           THEN greatest(least(x, 0.1 / (batch_idx + 1)), -0.1 / (batch_idx + 1))
         WHEN layer_idx = 2 AND site = 'k_all' THEN greatest(x, 0)
         WHEN layer_idx = 3 AND site = 'scores' THEN x * 2
         ELSE x END, 6) + 0.0 AS value
FROM s"""
)


STACK = [
    *[dp.Setting(layer, site, "steer", 0.3, 0) for layer in range(6) for site in ("h", "layer")],
    *[dp.Setting(layer, "h", "scale", 2.0, 1) for layer in (1, 3)],
    *[dp.Setting(layer, "h", "steer", 0.5, 2) for layer in range(6)],
]


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dp.apply_stack(sited(spark, sf_dir), STACK, ["group_id"])
    return components(out, ["group_id", "batch_idx", "layer_idx", "site"])


SQL_STACK = (
    SQL_SITED
    + """,
one AS (
  SELECT s.*, CASE WHEN site IN ('h', 'layer') THEN x - coalesce(0.3 * d, 0) ELSE x END AS x1
  FROM s JOIN shift USING (group_id, i)
),
two AS (
  SELECT *, CASE WHEN site = 'h' AND layer_idx IN (1, 3) THEN x1 * 2 ELSE x1 END AS x2 FROM one
),
shift2 AS (
  SELECT group_id, i,
         avg(x2) FILTER (batch_idx >= 2 AND batch_idx < 2 + numneg)
           - max(x2) FILTER (batch_idx = 0) AS d2
  FROM two GROUP BY ALL
)
SELECT group_id, batch_idx, layer_idx, site, i,
       round(CASE WHEN site = 'h' THEN x2 - coalesce(0.5 * d2, 0) ELSE x2 END, 6) + 0.0 AS value
FROM two JOIN shift2 USING (group_id, i)"""
)


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        pick(mod("l_partkey", 5), "h", "q_in", "a_ho", "k_all", "v_all").alias("site"),
        mod("l_suppkey", 16).alias("pos"),
        mod("l_partkey", 12).alias("past_len"),
        (mod("l_orderkey", 10) + 1).alias("chunk_len"),
        (F.col("l_returnflag") == "A").alias("protect"),
    )
    flagged = vo.select_span(rows)
    return flagged.groupBy("site", "past_len", "chunk_len", "protect", "in_span").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum")
    )


SQL_SPAN = """
WITH r AS (
  SELECT ['h', 'q_in', 'a_ho', 'k_all', 'v_all'][l_partkey % 5 + 1] AS site,
         l_suppkey % 16 AS pos, l_partkey % 12 AS past_len,
         l_orderkey % 10 + 1 AS chunk_len, l_returnflag = 'A' AS protect
  FROM lineitem
),
w AS (
  SELECT *,
    CASE WHEN site IN ('k_all', 'v_all')
         THEN CASE WHEN past_len < 6 THEN 6 - past_len ELSE 6 END
         ELSE greatest(6 - past_len, 0) END AS lo,
    CASE WHEN site IN ('k_all', 'v_all')
         THEN past_len + chunk_len - CASE WHEN protect THEN chunk_len ELSE 0 END
         ELSE CASE WHEN protect THEN 1 ELSE chunk_len END END AS hi
  FROM r
)
SELECT site, past_len, chunk_len, protect, pos BETWEEN lo AND hi - 1 AS in_span,
       count(*) AS n, sum(pos)::BIGINT AS pos_sum
FROM w GROUP BY ALL"""


def rotated(spark: SparkSession, sf_dir: str, noise: ns.Noise) -> DataFrame:
    return vo.rotate_random(
        table(spark, sf_dir, "embeddings").select(
            "vec_id", "label", F.col("embedding").cast("array<double>").alias("before")
        ),
        THETA,
        F.col("vec_id"),
        SEED,
        vec="before",
        out="after",
        noise=noise,
    )


def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(rotated(spark, sf_dir, ns.ARITHMETIC), ["vec_id"], "after")


def _sql_noise(key: str, component: str) -> str:
    mixed = f"(({key} % 65521) * 4867 + ({component}) * 6977 + {SEED} * 1693) % 65521"
    return f"((({mixed}) * ({mixed}) + ({mixed}) * 3 + 1) % 65521) / 65521.0::DOUBLE"


SQL_ROTATED = f"""
WITH {SQL_COMPONENTS},
r AS (SELECT vec_id, i, x, {_sql_noise("vec_id", "i + 1")} AS r FROM c),
p AS (SELECT vec_id, sum(r * x) / sum(x * x) AS along, sqrt(sum(x * x)) AS len FROM r GROUP BY 1),
o AS (SELECT r.vec_id, r.i, r.x, r.r - r.x * p.along AS o, p.len FROM r JOIN p USING (vec_id)),
n AS (SELECT vec_id, sqrt(sum(o * o)) AS olen FROM o GROUP BY 1),
a AS (
  SELECT o.vec_id, o.i, o.x, t.theta,
         o.x * cos(t.theta) + o.len * o.o / n.olen * sin(t.theta) AS y
  FROM o JOIN n USING (vec_id)
  JOIN (SELECT vec_id, {THETA} * {_sql_noise("vec_id", "0")} AS theta FROM embeddings) t
    USING (vec_id)
)"""

SQL_ROTATE = SQL_ROTATED + " SELECT vec_id, i, round(y, 6) + 0.0 AS value FROM a"


def rotate_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With hashed noise: the length is kept and the angle stays below theta."""
    out = rotated(spark, sf_dir, ns.HASHED)
    before, after = F.col("before"), F.col("after")
    return out.select(
        "vec_id",
        rounded(vx.norm(after) / vx.norm(before), 9).alias("length_ratio"),
        (vx.angle(before, after) < THETA + 1e-6).alias("within_theta"),
        (vx.norm(vx.subtract(after, before)) > 0).alias("moved"),
    )


SQL_ROTATE_INVARIANTS = """
SELECT vec_id, 1.0::DOUBLE AS length_ratio, true AS within_theta, true AS moved
FROM embeddings"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vo.angle_audit(
        rotated(spark, sf_dir, ns.ARITHMETIC), "before", "after", THETA, ["label"]
    )
    return out.withColumn("label", F.col("label").cast("long"))


# the angle of a rotated vector is its drawn angle
SQL_AUDIT = (
    SQL_ROTATED
    + """,
d AS (
  SELECT vec_id, acos(least(1, greatest(-1,
           sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))) AS angle
  FROM a GROUP BY 1
)
SELECT label::BIGINT AS label, round(avg(angle), 5) AS mean_angle,
       round(avg(angle) / 0.2, 2) AS ratio
FROM d JOIN embeddings USING (vec_id) GROUP BY 1"""
)


def audit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotated(spark, sf_dir, ns.ARITHMETIC)
    return vo.angle_audit_tables(
        vector_rows(spark, sf_dir),
        out.select("vec_id", F.col("after").alias("vec")),
        ["vec_id"],
        THETA,
    )


SQL_AUDIT_TABLES = SQL_AUDIT.replace("label::BIGINT AS label, ", "").replace(
    "FROM d JOIN embeddings USING (vec_id) GROUP BY 1", "FROM d"
)


def dosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site, block and position from the vector's number; long past, short chunk."""
    sites = ("a_ho", "v_all", "k_all", "q_in", "h", "h_post")
    rows = vector_rows(spark, sf_dir).select(
        "vec_id",
        pick(mod("vec_id", 6), *sites).alias("site"),
        mod("vec_id", 20).alias("block_idx"),
        F.lit(20).alias("total_blocks"),
        mod("vec_id", 16).alias("pos"),
        F.lit(7).alias("past_len"),
        F.lit(5).alias("chunk_len"),
        (F.col("vec_id") % 4 == 0).alias("protect"),
        "vec",
    )
    out = dose_vectors(
        rows, site_curves(spark), F.col("vec_id"), SEED, ns.ARITHMETIC
    )
    return components(out, ["vec_id"])


_SQL_DOSE = """
(SELECT vec_id, CASE WHEN
    CASE WHEN site IN ('k_all', 'v_all')
         THEN pos >= 6 AND pos < CASE WHEN vec_id % 4 = 0 THEN 7 ELSE 12 END
         ELSE pos < CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 5 END END
  THEN 0.1 * CASE site
    WHEN 'v_all' THEN CASE WHEN d < 5 THEN 1 ELSE 0 END
    WHEN 'k_all' THEN CASE WHEN d <= 5 THEN d / 5 WHEN d <= 30 THEN 1
      WHEN d < 35 THEN (35 - d) / 5 WHEN d = 35 THEN 0 WHEN d <= 60 THEN 1
      WHEN d <= 65 THEN (65 - d) / 5 ELSE 0 END
    WHEN 'q_in' THEN CASE WHEN d > 99 THEN 1 ELSE 0 END
    WHEN 'h' THEN CASE WHEN d <= 60 THEN 0 WHEN d <= 65 THEN (d - 60) / 5
      WHEN d <= 95 THEN 1 ELSE (100 - d) / 5 END
    ELSE 0 END ELSE 0 END AS dose
  FROM (SELECT vec_id, vec_id % 20 * 5 AS d, vec_id % 16 AS pos,
          ['a_ho', 'v_all', 'k_all', 'q_in', 'h', 'h_post'][vec_id % 6 + 1] AS site
        FROM embeddings))"""

SQL_DOSED = SQL_ROTATE.replace(
    f"(SELECT vec_id, {THETA} * {_sql_noise('vec_id', '0')} AS theta FROM embeddings)",
    f"(SELECT vec_id, dose * {_sql_noise('vec_id', '0')} AS theta FROM {_SQL_DOSE})",
)


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("score")
    )
    out = vo.group_softmax(scores, ["o_custkey"], "score")
    return out.select("o_custkey", "o_orderkey", rounded(F.col("weight"), 9).alias("weight"))


SQL_SOFTMAX = """
WITH m AS (SELECT o_custkey, max(o_totalprice / 1000) AS top FROM orders GROUP BY 1),
e AS (
  SELECT o_custkey, o_orderkey, exp(o_totalprice / 1000 - top) AS e
  FROM orders JOIN m USING (o_custkey)
)
SELECT o_custkey, o_orderkey,
       round(e / sum(e) OVER (PARTITION BY o_custkey), 9) + 0.0 AS weight
FROM e"""


def softmax_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups hold the whole table."""
    scores = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderkey", (F.col("o_totalprice") / 100000).alias("score")
    )
    out = vo.group_softmax(scores, ["o_orderstatus"], "score")
    return out.select("o_orderstatus", "o_orderkey", rounded(F.col("weight"), 10).alias("weight"))


SQL_SOFTMAX_HOT = """
WITH e AS (SELECT o_orderstatus, o_orderkey, exp(o_totalprice / 100000) AS e FROM orders)
SELECT o_orderstatus, o_orderkey,
       round(e / sum(e) OVER (PARTITION BY o_orderstatus), 10) + 0.0 AS weight
FROM e"""


def softmax_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the customers become one group, whose key is null."""
    scores = table(spark, sf_dir, "orders").select(
        F.when(mod("o_custkey", 3) > 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderkey",
        (F.col("o_totalprice") / 100000).alias("score"),
    )
    out = vo.group_softmax(scores, ["o_custkey"], "score")
    return out.select("o_custkey", "o_orderkey", rounded(F.col("weight"), 9).alias("weight"))


SQL_SOFTMAX_NULLS = """
WITH e AS (
  SELECT CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS o_custkey, o_orderkey,
         exp(o_totalprice / 100000) AS e
  FROM orders
)
SELECT o_custkey, o_orderkey,
       round(e / sum(e) OVER (PARTITION BY o_custkey), 9) + 0.0 AS weight
FROM e"""


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    positioned = vector_rows(spark, sf_dir).select(
        div("vec_id", 50).alias("group_id"), mod("vec_id", 50).alias("pos"), "vec"
    )
    return vo.split_vec(positioned, 4)


def _lookup(spark: SparkSession, sf_dir: str, window: int, causal: bool, bias: Column | None):
    heads = _heads(spark, sf_dir)
    keys = heads.filter(F.col("head") < 2).select(
        "group_id", "head", "pos", vx.scale(F.col("vec"), F.lit(8.0)).alias("key"),
        F.col("vec").alias("value"),
    )
    out = weighted_lookup(
        heads, keys, ["group_id"], window, heads_per_key=2, causal=causal, bias=bias
    )
    return components(
        out.withColumn("head", F.col("head").cast("long")), ["group_id", "head", "pos"], "out"
    )


def lookup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    bias = F.when(mod("pos", 7) == 0, -1.0).otherwise(0.0)
    return _lookup(spark, sf_dir, 20, True, bias)


def lookup_whole_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir, 64, False, None)


def _sql_lookup(visible: str, bias: str) -> str:
    return f"""
WITH {SQL_COMPONENTS},
h AS (
  SELECT vec_id // 50 AS group_id, vec_id % 50 AS pos, i // 16 AS head, i % 16 AS i, x FROM c
),
v AS (SELECT group_id, pos, head, list(x ORDER BY i) AS x FROM h GROUP BY ALL),
w AS (
  SELECT q.group_id, q.head, q.pos, k.pos AS kpos,
         exp(list_dot_product(q.x, k.x) * 8 / 4 + {bias}) AS e
  FROM v q JOIN v k ON q.group_id = k.group_id AND k.head = q.head // 2 AND {visible}
)
SELECT w.group_id, w.head, w.pos, h.i, round(sum(w.e * h.x) / sum(w.e), 6) + 0.0 AS value
FROM w JOIN h ON h.group_id = w.group_id AND h.pos = w.kpos AND h.head = w.head // 2
GROUP BY ALL"""


def lookup_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No window; a third of all vectors is in one group, whose key is null."""
    group = F.when(mod("vec_id", 3) > 0, div("vec_id", 50))
    heads = vo.split_vec(
        vector_rows(spark, sf_dir).select(
            group.alias("group_id"), F.col("vec_id").alias("pos"), "vec"
        ),
        4,
    )
    keys = heads.filter(F.col("head") < 2).select(
        "group_id", "head", "pos", vx.scale(F.col("vec"), F.lit(40.0)).alias("key"),
        F.col("vec").alias("value"),
    )
    bias = F.when(mod("pos", 7) == 0, -1.0).otherwise(0.0)
    out = weighted_lookup(
        heads, keys, ["group_id"], heads_per_key=2, bias=bias, tile=256, dim=16
    )
    return components(
        out.withColumn("head", F.col("head").cast("long")), ["group_id", "head", "pos"], "out"
    )


SQL_LOOKUP_UNBOUNDED = f"""
WITH {SQL_COMPONENTS},
h AS (
  SELECT CASE WHEN vec_id % 3 > 0 THEN vec_id // 50 ELSE -1 END AS g, vec_id AS pos,
         i // 16 AS head, i % 16 AS i, x FROM c
),
v AS (SELECT g, pos, head, list(x ORDER BY i) AS x FROM h GROUP BY ALL),
w AS (
  SELECT q.g, q.head, q.pos, k.pos AS kpos,
         list_dot_product(q.x, k.x) * 40 / 4 - CASE WHEN k.pos % 7 = 0 THEN 1 ELSE 0 END AS s
  FROM v q JOIN v k ON q.g = k.g AND k.head = q.head // 2 AND k.pos <= q.pos
),
e AS (
  SELECT g, head, pos, kpos, exp(s - max(s) OVER (PARTITION BY g, head, pos)) AS e FROM w
)
SELECT nullif(e.g, -1) AS group_id, e.head, e.pos, h.i,
       round(sum(e.e * h.x) / sum(e.e), 6) + 0.0 AS value
FROM e JOIN h ON h.g = e.g AND h.pos = e.kpos AND h.head = e.head // 2
GROUP BY ALL"""


def heads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = vo.split_vec(vector_rows(spark, sf_dir), 8)
    scaled = heads.withColumn("vec", vx.scale(F.col("vec"), F.col("head") + 1.0))
    return components(vo.concat_vec(scaled, ["vec_id"]), ["vec_id"])


SQL_HEADS = f"""
WITH {SQL_COMPONENTS}
SELECT vec_id, i, round(x * (i // 8 + 1), 6) + 0.0 AS value FROM c"""


def heads_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = vo.split_vec(vector_rows(spark, sf_dir), 8)
    return components(
        heads.withColumn("head", F.col("head").cast("long")), ["vec_id", "head"]
    )


SQL_HEADS_SPLIT = f"""
WITH {SQL_COMPONENTS}
SELECT vec_id, i // 8 AS head, i % 8 AS i, round(x, 6) + 0.0 AS value FROM c"""


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_rows(spark, sf_dir).withColumn(
        "vec", vx.mask_tail(F.col("vec"), mod("vec_id", 9).cast("int"))
    )
    return components(rows, ["vec_id"])


SQL_TAIL = f"""
WITH {SQL_COMPONENTS}
SELECT vec_id, i, round(CASE WHEN i >= 64 - vec_id % 9 THEN -65504 ELSE x END, 6) + 0.0 AS value
FROM c"""


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return vo.last_position(rows, ["user_id"], "event_id")


SQL_LAST = """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""


def xent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_rows(spark, sf_dir).select(
        div("vec_id", 20).alias("seq_id"),
        mod("vec_id", 20).alias("pos"),
        vx.scale(F.col("vec"), F.lit(5.0)).alias("scores"),
        F.when(mod("vec_id", 6) == 0, -100)
        .otherwise((F.col("vec_id") * 7) % 64)
        .cast("int")
        .alias("label"),
    )
    out = vo.shifted_xent(rows, rows, ["seq_id"], group=["seq_id"])
    return out.withColumn("loss", rounded(F.col("loss")))


SQL_XENT = f"""
WITH {SQL_COMPONENTS},
z AS (SELECT vec_id, ln(sum(exp(5 * x))) AS z FROM c GROUP BY 1),
l AS (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN NULL ELSE vec_id * 7 % 64 END AS label
      FROM embeddings)
SELECT c.vec_id // 20 AS seq_id, round(avg(z.z - 5 * c.x), 6) + 0.0 AS loss, count(*) AS n
FROM c JOIN z USING (vec_id)
JOIN l ON l.vec_id = c.vec_id + 1 AND l.vec_id // 20 = c.vec_id // 20 AND l.label = c.i
GROUP BY 1"""


def draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = vector_rows(spark, sf_dir).select(
        "vec_id", F.posexplode("vec").alias("cand", "x")
    ).select("vec_id", F.col("cand").cast("long").alias("cand"), (F.col("x") * 10).alias("score"))
    return vo.weighted_draw(
        candidates, ["vec_id"], "cand", "score", SEED, ns.ARITHMETIC, F.col("vec_id")
    )


SQL_DRAW = f"""
WITH {SQL_COMPONENTS},
g AS (
  SELECT vec_id, i, 10 * x - ln(-ln(greatest({_sql_noise("vec_id", "i")}, pow(2.0, -54)))) AS g
  FROM c
)
SELECT vec_id, arg_max(i, g) AS cand FROM g GROUP BY 1"""


QUERIES = {
    "steer_from_negatives": steer,
    "apply_settings": dispatch,
    "apply_stack": stack,
    "apply_user_functions": user_functions,
    "select_span": span,
    "rotate_random": rotate,
    "rotate_random_invariants": rotate_invariants,
    "angle_audit": audit,
    "angle_audit_tables": audit_tables,
    "dose_vectors": dosed,
    "group_softmax": softmax,
    "group_softmax_hot_groups": softmax_hot,
    "group_softmax_null_groups": softmax_nulls,
    "weighted_lookup_window": lookup_window,
    "weighted_lookup_whole_group": lookup_whole_group,
    "weighted_lookup_unbounded": lookup_unbounded,
    "split_heads": heads_split,
    "concat_heads": heads_round_trip,
    "mask_tail": tail,
    "last_position": last,
    "shifted_cross_entropy": xent,
    "weighted_draw": draw,
}

ORACLES = {
    "steer_from_negatives": SQL_STEER,
    "apply_settings": SQL_DISPATCH,
    "apply_stack": SQL_STACK,
    "apply_user_functions": SQL_USER_FUNCTIONS,
    "select_span": SQL_SPAN,
    "rotate_random": SQL_ROTATE,
    "rotate_random_invariants": SQL_ROTATE_INVARIANTS,
    "angle_audit": SQL_AUDIT,
    "angle_audit_tables": SQL_AUDIT_TABLES,
    "dose_vectors": SQL_DOSED,
    "group_softmax": SQL_SOFTMAX,
    "group_softmax_hot_groups": SQL_SOFTMAX_HOT,
    "group_softmax_null_groups": SQL_SOFTMAX_NULLS,
    "weighted_lookup_window": _sql_lookup(
        "k.pos <= q.pos AND k.pos > q.pos - 20", "CASE WHEN k.pos % 7 = 0 THEN -1 ELSE 0 END"
    ),
    "weighted_lookup_whole_group": _sql_lookup("true", "0"),
    "weighted_lookup_unbounded": SQL_LOOKUP_UNBOUNDED,
    "split_heads": SQL_HEADS_SPLIT,
    "concat_heads": SQL_HEADS,
    "mask_tail": SQL_TAIL,
    "last_position": SQL_LAST,
    "shifted_cross_entropy": SQL_XENT,
    "weighted_draw": SQL_DRAW,
}
