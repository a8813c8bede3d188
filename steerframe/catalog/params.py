"""Settings-tree queries: one tree per customer, changed and read by its orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steerframe.catalog.common import mod, spread, table
from steerframe.functions import curves as cv
from steerframe.operators import curves as co, params as po
from steerframe.plans import dosing
from steerframe.session import scratch_path
from steerframe.sources import settings_store as store
from steerframe.streaming import updates as up

PROFILE_NAMES = list(cv.PROFILES)


def _leaf(name: str, value: Column) -> Column:
    """A named node with a value and a label that looks like JSON."""
    return F.concat(
        F.lit(f'"{name}":{{"widget_type":"Box","attributes":{{"label":"{{\\"x\\":1}}","value":'),
        value,
        F.lit("}}"),
    )


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site ``h`` with its globals and its profiles; profile i is on by a key bit."""
    key = F.col("c_custkey")
    profiles = F.concat_ws(
        ",",
        *[
            _leaf(name, ((F.floor(key / 2**i) % 2) == 1).cast("string"))
            for i, name in enumerate(PROFILE_NAMES)
        ],
    )
    tree = F.concat(
        F.lit('{"h":{"container_type":"Column","sub_attr":{"type_globals":{"sub_attr":{'),
        _leaf("dose_theta", (key % 100).cast("string")),
        F.lit(","),
        _leaf("options", F.lit("true")),
        F.lit('}},"shape_sliders":{"sub_attr":{'),
        profiles,
        F.lit('}}}},"weight":{"attributes":{"value":"w"}}}'),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        F.concat(F.lit("c"), key).alias("owner"), tree.alias("tree")
    )


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.flatten_params(trees(spark, sf_dir), "tree", ["owner"])


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.values_only(leaves(spark, sf_dir))


# every customer's values: names as one string, the place among siblings, JSON text
_SQL_VALUES = """
p(i, name) AS (
  VALUES (0, 'input_noise'), (1, 'early_noise'), (2, 'mid_noise'), (3, 'late_noise'),
         (4, 'output_noise')
),
v AS (
  SELECT 'c' || c_custkey AS owner, 'h/type_globals/dose_theta' AS path, 0 AS pos,
         (c_custkey % 100)::VARCHAR AS value FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'h/type_globals/options', 1, 'true' FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'weight', 1, '"w"' FROM customer
  UNION ALL
  SELECT 'c' || c_custkey, 'h/shape_sliders/' || name, i,
         CASE WHEN (c_custkey >> i) & 1 = 1 THEN 'true' ELSE 'false' END
  FROM customer, p
)"""


def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark, sf_dir).select(
        "owner",
        F.array_join("path", "/").alias("path"),
        "value",
    )


SQL_FLATTEN = f"""
WITH {_SQL_VALUES},
n AS (SELECT owner, value, replace(path, '/', '/sub_attr/') AS path FROM v)
SELECT owner, path || '/attributes/value' AS path, value FROM n
UNION ALL
SELECT owner, path || '/attributes/label', '"{{\\"x\\":1}}"' FROM n WHERE path <> 'weight'
UNION ALL
SELECT owner, path || '/widget_type', '"Box"' FROM n WHERE path <> 'weight'
UNION ALL
SELECT DISTINCT owner, 'h/container_type', '"Column"' FROM n"""


def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = po.flatten_params(table(spark, sf_dir, "events"), "props", ["event_id"])
    return out.select("event_id", F.array_join("path", "/").alias("path"), "value")


SQL_FLATTEN_EVENTS = """
SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events"""


def flatten_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some trees are cut off, followed by text, repeated in a name, no object, or null."""
    kind = mod("event_id", 7)
    tree = (
        F.when(kind == 0, F.expr("left(props, length(props) - 1)"))
        .when(kind == 1, F.concat("props", F.lit(" x")))
        .when(kind == 2, F.regexp_replace("props", r"^\{(.*)\}$", '{$1,"o":{"q":[1, 2],$1},$1}'))
        .when(kind == 3, F.concat(F.lit("["), "props", F.lit("]")))
        .when(kind != 4, F.col("props"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", tree.alias("tree"))
    out = po.flatten_params(rows, "tree", ["event_id"])
    return out.select(
        "event_id", F.array_join("path", "/").alias("path"), "value",
        F.col("error").isNotNull().alias("broken"),
    )


SQL_FLATTEN_BROKEN = """
WITH e AS (
  SELECT event_id, event_id % 7 AS kind, props, json_extract_string(props, '$.k') AS k
  FROM events
)
SELECT event_id, NULL AS path, CASE kind WHEN 0 THEN left(props, length(props) - 1)
    WHEN 1 THEN props || ' x' WHEN 3 THEN '[' || props || ']' END AS value, true AS broken
FROM e WHERE kind IN (0, 1, 3, 4)
UNION ALL SELECT event_id, 'k', k, false FROM e WHERE kind IN (2, 5, 6)
UNION ALL SELECT event_id, 'k', k, false FROM e WHERE kind = 2
UNION ALL SELECT event_id, 'o/k', k, false FROM e WHERE kind = 2
UNION ALL SELECT event_id, 'o/q', '[1, 2]', false FROM e WHERE kind = 2"""


def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of 2 to 200 levels for each customer, flattened and put together again."""
    depth = (mod("c_custkey", 199) + 2).cast("int")
    level = F.lit('{"n":{"sub_attr":')
    leaf = F.concat(F.lit('{"n":{"attributes":{"value":'), F.col("c_custkey"), F.lit("}}}"))
    tree = F.concat(F.repeat(level, depth - 1), leaf, F.repeat(F.lit("}}"), depth - 1))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    rows = rows.select("c_custkey", tree.alias("tree"))
    flat = po.values_only(po.flatten_params(rows, "tree", ["c_custkey"]))
    return po.unflatten(flat, ["c_custkey"]).select("c_custkey", "tree")


SQL_DEEP_TREES = """
SELECT c_custkey, repeat('{"n":{"sub":', (c_custkey % 199 + 1)::INT)
    || '{"n":{"value":' || c_custkey || '}}' || repeat('}}', (c_custkey % 199 + 1)::INT) AS tree
FROM customer"""


def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(values(spark, sf_dir))


SQL_PRUNE = f"WITH {_SQL_VALUES} SELECT owner, path, value FROM v"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for one of its customer's parameters, with or without containers."""
    paths = [
        ["h", "type_globals", "dose_theta"],
        ["h", "sub_attr", "shape_sliders", "sub_attr", "mid_noise"],
        ["sub_attr", "weight"],
        ["h", "no", "such"],
    ]
    asked = F.get(
        F.array(*[F.array(*[F.lit(p) for p in path]) for path in paths]),
        mod("o_orderkey", 4).cast("int"),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey")).alias("owner"), asked.alias("path")
    )


def look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = po.lookup(
        values(spark, sf_dir), requests(spark, sf_dir), ["owner"]
    )
    return out.select("o_orderkey", "value")


SQL_LOOK_UP = f"""
WITH {_SQL_VALUES}
SELECT o.o_orderkey, v.value FROM orders o LEFT JOIN v
  ON v.owner = 'c' || o.o_custkey AND v.path = ['h/type_globals/dose_theta',
     'h/shape_sliders/mid_noise', 'weight', 'h/no/such'][o.o_orderkey % 4 + 1]"""


def subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for a subtree: an inner node with or without containers, a leaf, or none."""
    paths = [["h"], ["h", "sub_attr", "shape_sliders"], ["h", "shape_sliders", "mid_noise"],
             ["h", "sub_attr", "type_globals", "sub_attr", "options", "attributes"], ["h", "no"]]
    asked = F.get(
        F.array(*[F.array(*[F.lit(p) for p in path]) for path in paths]),
        mod("o_orderkey", 5).cast("int"),
    )
    wanted = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey")).alias("owner"), asked.alias("path")
    )
    nodes = po.tree_nodes(trees(spark, sf_dir), "tree", ["owner"])
    out = po.subtree(nodes, wanted, ["owner"], width=8)
    return out.select("o_orderkey", F.array_join("node", "/").alias("node"), "value")


SQL_SUBTREES = f"""
WITH {_SQL_VALUES},
leaf AS (
  SELECT owner, path || '/attributes/value' AS node, value FROM v
  UNION ALL SELECT owner, path || '/attributes/label', '"{{\\"x\\":1}}"' FROM v WHERE path <> 'weight'
  UNION ALL SELECT owner, path || '/widget_type', '"Box"' FROM v WHERE path <> 'weight'
  UNION ALL SELECT DISTINCT owner, 'h/container_type', '"Column"' FROM v
),
r AS (
  SELECT o_orderkey, 'c' || o_custkey AS owner, ['h', 'h/shape_sliders', 'h/shape_sliders/mid_noise',
    'h/type_globals/options/attributes', 'h/no'][o_orderkey % 5 + 1] AS path
  FROM orders
)
SELECT o_orderkey, node, value
FROM r LEFT JOIN leaf ON leaf.owner = r.owner AND starts_with(node, path || '/')"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order sets a profile, the dose or a parameter its customer did not have."""
    target = mod("o_orderkey", 3)
    path = (
        F.when(target == 0, F.array(F.lit("h"), F.lit("shape_sliders"), F.lit("early_noise")))
        .when(target == 1, F.array(F.lit("h"), F.lit("type_globals"), F.lit("dose_theta")))
        .otherwise(F.array(F.lit("new")))
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("owner"),
        path.alias("path"),
        F.when(target == 0, (F.col("o_totalprice") > 250000).cast("string"))
        .otherwise(F.col("o_orderkey").cast("string"))
        .alias("value"),
        F.col("o_orderdate").alias("ts"),
    )


_SQL_UPDATES = """
u AS (
  SELECT 'c' || o_custkey AS owner,
    ['h/shape_sliders/early_noise', 'h/type_globals/dose_theta', 'new'][o_orderkey % 3 + 1]
      AS path,
    CASE WHEN o_orderkey % 3 = 0
         THEN CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END
         ELSE o_orderkey::VARCHAR END AS value,
    o_orderdate AS ts
  FROM orders
),
latest AS (
  SELECT owner, path, value FROM u
  QUALIFY row_number() OVER (PARTITION BY owner, path ORDER BY ts DESC, value DESC) = 1
)"""


def _latest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = updates(spark, sf_dir)
    return po.upsert(changes.limit(0), changes, ["owner"])


def _named(df: DataFrame) -> DataFrame:
    return df.select("owner", F.array_join("path", "/").alias("path"), "value")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(po.upsert(values(spark, sf_dir), updates(spark, sf_dir), ["owner"]))


SQL_UPSERT = f"""
WITH {_SQL_VALUES}, {_SQL_UPDATES}
SELECT owner, path, coalesce(latest.value, v.value) AS value
FROM v FULL JOIN latest USING (owner, path)"""


def _run_updates(spark: SparkSession, sf_dir: str, on_change=None) -> str:
    """The same updates read as a stream, a file to a batch, times in no order over the files."""
    changes, path = updates(spark, sf_dir), scratch_path(spark, "updates")
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    timed.repartition(5, F.xxhash64("owner", "ts", "value")).write.parquet(f"{path}/in")
    stream = (
        spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    )
    query = (
        up.apply_updates(
            stream, values(spark, sf_dir), f"{path}/settings",
            on_change, buckets=4, compact_after=2,
        )
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{path}/settings"


def update_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings after the last batch of updates."""
    return _named(up.read_settings(spark, _run_updates(spark, sf_dir)))


def updates_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback of the user's, run after each batch: what is on for each owner, and its dose."""
    out = scratch_path(spark, "callback")

    def rebuild(settings: DataFrame, epoch: int) -> None:
        dose = F.when(F.element_at("path", -1) == "dose_theta", F.col("value").try_cast("long"))
        settings.groupBy("owner").agg(
            F.count_if(F.col("value") == "true").alias("n_on"), F.max(dose).alias("dose")
        ).write.mode("overwrite").parquet(f"{out}/after-{epoch}")
        done.append(epoch)

    done: list[int] = []
    _run_updates(spark, sf_dir, rebuild)
    return spark.read.parquet(f"{out}/after-{done[-1]}")


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(
        po.reconcile(values(spark, sf_dir), _latest_updates(spark, sf_dir), ["owner"])
    )


SQL_CALLBACK = f"""
WITH {_SQL_VALUES}, {_SQL_UPDATES},
now AS (
  SELECT owner, path, coalesce(latest.value, v.value) AS value
  FROM v FULL JOIN latest USING (owner, path)
)
SELECT owner, count(*) FILTER (value = 'true') AS n_on,
       max(try_cast(value AS BIGINT)) FILTER (path LIKE '%dose_theta') AS dose
FROM now GROUP BY 1"""


SQL_RECONCILE = f"""
WITH {_SQL_VALUES}, {_SQL_UPDATES}
SELECT owner, path, coalesce(latest.value, v.value) AS value
FROM v LEFT JOIN latest USING (owner, path)"""


def unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.unflatten(values(spark, sf_dir), ["owner"])


SQL_UNFLATTEN = """
SELECT 'c' || c_custkey AS owner,
  '{"h":{"sub":{"shape_sliders":{"sub":{'
  || array_to_string(list_transform(
       [['early_noise', '1'], ['input_noise', '0'], ['late_noise', '3'], ['mid_noise', '2'],
        ['output_noise', '4']],
       lambda p: '"' || p[1] || '":{"value":'
         || CASE WHEN (c_custkey >> p[2]::INT) & 1 = 1 THEN 'true' ELSE 'false' END || '}'), ',')
  || '}},"type_globals":{"sub":{"dose_theta":{"value":' || c_custkey % 100
  || '},"options":{"value":true}}}}},"weight":{"value":"w"}}' AS tree
FROM customer"""


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer chooses brands; a brand's tree holds its number of parts."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.format_string('{"n":%d}', F.count(F.lit(1))).alias("tree")
    )
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 4 == 0, F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")),
                F.concat(F.lit("Brand#"), (key * 7 % 40).cast("string")),
            )
        )
        .alias("chosen"),
    )
    out = po.select_sets(
        customers,
        brands.withColumnRenamed("p_brand", "set_name"),
        "chosen",
        "Brand#1",
    )
    return out.withColumn("set_ord", F.col("set_ord").cast("long"))


SQL_SETS = """
WITH b AS (SELECT p_brand, '{"n":' || count(*) || '}' AS tree FROM part GROUP BY 1),
c AS (
  SELECT c_custkey, 0 AS set_ord,
    CASE WHEN c_custkey % 4 = 0 THEN 'Brand#1' ELSE 'Brand#' || (c_custkey % 25 + 1) END
      AS set_name FROM customer
  UNION ALL
  SELECT c_custkey, 1, 'Brand#' || (c_custkey * 7 % 40) FROM customer WHERE c_custkey % 4 <> 0
)
SELECT c_custkey, set_ord::BIGINT AS set_ord, set_name, coalesce(b.tree, '{}') AS tree
FROM c LEFT JOIN b ON b.p_brand = c.set_name"""


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every customer's values as JSON and read them back."""
    path = scratch_path(spark, "settings")
    store.write_params(values(spark, sf_dir), path)
    saved = store.read_params(spark, path)
    return saved.select(
        po.tag(F.col("owner"), F.col("path")).alias("tag"), "value"
    )


SQL_ROUND_TRIP = f"""
WITH {_SQL_VALUES}
SELECT owner || '_-_' || replace(path, '/', '_-_') AS tag, value FROM v"""


def documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every customer's tree and the choice of sets as documents beside three broken
    lines, and read them back: parameters, choice and broken lines."""
    path = scratch_path(spark, "documents")
    first = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.min("c_custkey").cast("int").alias("set_ord")
    )
    store.write_documents(
        values(spark, sf_dir), first.withColumnRenamed("c_mktsegment", "owner"), path
    )
    broken = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(
        F.format_string('{"params":{"%s":', "r_name").alias("value")
    )
    broken.write.mode("append").text(path)
    documents = store.read_documents(spark, path)
    params = store.document_params(documents).select(
        po.tag(F.col("owner"), F.col("path")).alias("tag"), "value"
    )
    choice = store.document_choice(documents).select(
        F.format_string("choice %d", "set_ord").alias("tag"), F.col("owner").alias("value")
    )
    lost = store.broken_documents(documents).select(F.lit("broken").alias("tag"), "value")
    return params.unionByName(choice).unionByName(lost)


SQL_DOCUMENTS = f"""
WITH {_SQL_VALUES},
s AS (SELECT c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY 1)
SELECT owner || '_-_' || replace(path, '/', '_-_') AS tag, value FROM v
UNION ALL
SELECT 'choice ' || row_number() OVER (ORDER BY first) - 1, c_mktsegment FROM s
UNION ALL
SELECT 'broken', '{{"params":{{"' || r_name || '":' FROM region WHERE r_regionkey < 3"""


def chosen_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the market segments in order of their first customer as the choice of sets."""
    first = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.min("c_custkey").cast("int").alias("set_ord")
    )
    path = scratch_path(spark, "chosen")
    store.write_chosen(first.withColumnRenamed("c_mktsegment", "owner"), path)
    return store.read_chosen(spark, path).select(
        F.col("set_ord").cast("long").alias("set_ord"), "owner"
    )


SQL_CHOSEN_ROUND_TRIP = """
SELECT min(c_custkey) AS set_ord, c_mktsegment AS owner FROM customer GROUP BY 2"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = co.profile_slots(trees(spark, sf_dir), "tree", ["owner"], "shape_sliders")
    return co.selected_profiles(slots).withColumn("sib_ord", F.col("sib_ord").cast("long"))


SQL_PROFILES = f"""
WITH {_SQL_VALUES}
SELECT owner, 'h' AS site, pos::BIGINT AS sib_ord, split_part(path, '/', 3) AS name
FROM v WHERE path LIKE 'h/shape_sliders/%' AND value = 'true'"""


def redose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole job: change settings, select and merge profiles, dose 20 blocks per customer."""
    changes = updates(spark, sf_dir)
    blocks = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("owner"),
        F.lit("h").alias("site"),
        F.explode(F.sequence(F.lit(0), F.lit(19))).alias("block_idx"),
        F.lit(20).alias("total_blocks"),
    )
    out = dosing.redose(trees(spark, sf_dir), "tree", changes, blocks, ["owner"])
    return out.select(
        "owner",
        F.col("block_idx").cast("long").alias("block_idx"),
        F.round("shaped_dose", 6).alias("shaped_dose"),
    )


SQL_REDOSE = f"""
WITH {_SQL_VALUES}, {_SQL_UPDATES},
now AS (
  SELECT owner, path, coalesce(latest.value, v.value) AS value
  FROM v LEFT JOIN latest USING (owner, path)
),
s AS (
  SELECT owner, max(value) FILTER (path = 'h/type_globals/dose_theta')::DOUBLE AS dose,
    list(split_part(path, '/', 3)) FILTER (path LIKE 'h/shape%' AND value = 'true') AS sel
  FROM now GROUP BY 1
),
b AS (
  SELECT s.*, unnest(range(20)) AS block_idx FROM s
),
f(sib, ord, name, depth, ratio, skip) AS (
  VALUES (0, 0, 'input_noise', 1, 1.0::DOUBLE, false), (0, 1, 'input_noise', 5, 0, false),
    (1, 0, 'early_noise', 0, 0, true), (1, 1, 'early_noise', 5, 1, false),
    (1, 2, 'early_noise', 30, 1, false), (1, 3, 'early_noise', 35, 0, false),
    (2, 0, 'mid_noise', 30, 0, true), (2, 1, 'mid_noise', 35, 1, false),
    (2, 2, 'mid_noise', 60, 1, false), (2, 3, 'mid_noise', 65, 0, false),
    (3, 0, 'late_noise', 60, 0, true), (3, 1, 'late_noise', 65, 1, false),
    (3, 2, 'late_noise', 95, 1, false), (3, 3, 'late_noise', 100, 0, false),
    (4, 0, 'output_noise', 99, 0, true), (4, 1, 'output_noise', 100, 1, false)
),
k AS (
  SELECT s.owner, f.*, row_number() OVER (PARTITION BY owner ORDER BY sib, ord) AS n
  FROM s JOIN f ON list_contains(s.sel, f.name)
  WHERE NOT (f.skip AND (f.sib = 0 OR list_contains(s.sel,
    ['input_noise', 'early_noise', 'mid_noise', 'late_noise', 'output_noise'][f.sib])))
),
ends AS (
  SELECT owner, arg_min(depth, n) AS d0, arg_min(ratio, n) AS r0,
         arg_max(depth, n) AS d9, arg_max(ratio, n) AS r9 FROM k GROUP BY 1
),
seg AS (
  SELECT owner, n, depth AS d1, ratio AS r1,
         lead(depth) OVER w AS d2, lead(ratio) OVER w AS r2
  FROM k WINDOW w AS (PARTITION BY owner ORDER BY n)
),
hit AS (
  SELECT b.owner, b.block_idx, seg.* EXCLUDE (owner) FROM b
  JOIN seg ON seg.owner = b.owner AND b.block_idx * 5 BETWEEN seg.d1 AND seg.d2
  QUALIFY row_number() OVER (PARTITION BY b.owner, b.block_idx ORDER BY seg.n) = 1
)
SELECT b.owner, b.block_idx, round(coalesce(b.dose * CASE
    WHEN b.block_idx * 5 <= e.d0 THEN e.r0 WHEN b.block_idx * 5 >= e.d9 THEN e.r9
    WHEN NOT list_has_any(b.sel, ['early_noise', 'mid_noise', 'late_noise']) OR h.d1 = h.d2
      THEN greatest(coalesce(h.r1, e.r0), coalesce(h.r2, e.r9))
    ELSE coalesce(h.r1, e.r0) + (b.block_idx * 5 - coalesce(h.d1, e.d0))
      / (coalesce(h.d2, e.d9) - coalesce(h.d1, e.d0)) * (coalesce(h.r2, e.r9) - coalesce(h.r1, e.r0))
    END, 0), 6) + 0.0 AS shaped_dose
FROM b LEFT JOIN ends e USING (owner) LEFT JOIN hit h USING (owner, block_idx)"""


QUERIES = {
    "flatten_params": flatten,
    "flatten_params_events": flatten_events,
    "flatten_params_broken": flatten_broken,
    "unflatten_deep": deep_trees,
    "lookup_subtree": subtrees,
    "values_only": prune,
    "lookup": look_up,
    "upsert": upsert,
    "apply_updates_stream": update_stream,
    "apply_updates_callback": updates_callback,
    "reconcile": reconcile,
    "unflatten": unflatten,
    "select_sets": sets,
    "write_read_params": round_trip,
    "write_read_chosen": chosen_round_trip,
    "write_read_documents": documents_round_trip,
    "selected_profiles": profiles,
    "redose": redose,
}

ORACLES = {
    "flatten_params": SQL_FLATTEN,
    "flatten_params_events": SQL_FLATTEN_EVENTS,
    "flatten_params_broken": SQL_FLATTEN_BROKEN,
    "unflatten_deep": SQL_DEEP_TREES,
    "lookup_subtree": SQL_SUBTREES,
    "values_only": SQL_PRUNE,
    "lookup": SQL_LOOK_UP,
    "upsert": SQL_UPSERT,
    "apply_updates_stream": SQL_UPSERT,
    "apply_updates_callback": SQL_CALLBACK,
    "reconcile": SQL_RECONCILE,
    "unflatten": SQL_UNFLATTEN,
    "select_sets": SQL_SETS,
    "write_read_params": SQL_ROUND_TRIP,
    "write_read_chosen": SQL_CHOSEN_ROUND_TRIP,
    "write_read_documents": SQL_DOCUMENTS,
    "selected_profiles": SQL_PROFILES,
    "redose": SQL_REDOSE,
}
