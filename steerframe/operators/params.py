"""Settings trees: flatten, look up, change, reconcile, rebuild, select."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from steerframe.functions import trees as tr
from steerframe.operators.skew import attach, null_safe, too_large_to_copy
from steerframe.schemas import require

# Tree keys that hold a node's attributes, its value and its children,
# their names in a saved tree, and the separator of a path written as one string.
ATTRIBUTES, VALUE, CHILDREN = "attributes", "value", "sub_attr"
SAVED_VALUE, SAVED_CHILDREN = "value", "sub"
PATH_SEPARATOR = "_-_"

# Numbers of a tree's nodes that are looked up together.
SUBTREE_BIN = 1024


def _arrow_schema(df: DataFrame, keys: list[str], rest: str) -> tuple[str, pa.Schema]:
    """The keys' columns and some more, for Spark and for Arrow."""
    own = df.select(*keys).schema
    schema = T.StructType([*own.fields, *T.StructType.fromDDL(rest).fields])
    return schema, to_arrow_schema(schema)


def _read_trees(df: DataFrame, json_col: str, key_cols: list[str], rows_of, rest: str) -> DataFrame:
    schema, arrow = _arrow_schema(df, key_cols, rest)
    return df.select(*key_cols, F.col(json_col).alias("_tree")).mapInArrow(
        partial(tr.read_batches, keys=key_cols, rows_of=rows_of, schema=arrow), schema
    )


def flatten_params(df: DataFrame, json_col: str, key_cols: list[str]) -> DataFrame:
    """One row per value of a JSON tree: its ``path`` and its ``value`` as JSON text.

    A tree of any depth is read in one pass inside its row; a name that comes twice gives two
    rows. A null, a broken text or one that is no object gives one row with a null path, the
    text as its value, and the reason as its ``error``, which is null everywhere else.
    """
    require(df, [json_col, *key_cols], "flatten_params")
    return _read_trees(
        df, json_col, key_cols, tr.leaves, "path array<string>, value string, error string"
    )


def tree_nodes(df: DataFrame, json_col: str, key_cols: list[str]) -> DataFrame:
    """One row per member of a JSON tree's objects: ``path``, ``entry``, ``leave``, ``values``,
    ``value``.

    Members are numbered as they are written; what lies below one has the numbers from its
    ``entry`` + 1 to ``leave`` - 1, so a subtree is a range of numbers, with that many
    ``values`` in it. The value of an object is null. Broken trees are told as by
    ``flatten_params``.
    """
    require(df, [json_col, *key_cols], "tree_nodes")
    return _read_trees(
        df, json_col, key_cols, tr.members,
        "path array<string>, entry long, leave long, values long, value string, error string",
    )


def values_at(params: DataFrame, ending: list[str], children: str) -> DataFrame:
    """Keep the rows whose path is names, with ``children`` between them, and then ``ending``;
    the path becomes the names alone."""
    n, last = F.size("path"), len(ending)
    names_end = n - last
    containers = F.filter("path", lambda _, i: (i % 2 == 1) & (i < names_end))
    matches = (
        (names_end >= 1)
        & (names_end % 2 == 1)
        & (F.slice("path", -last, last) == F.array(*map(F.lit, ending)))
        & F.forall(containers, lambda c: c == children)
    )
    names = F.filter("path", lambda _, i: (i % 2 == 0) & (i < names_end))
    return params.filter(F.size("path") > last).filter(matches).withColumn("path", names)


def values_only(params: DataFrame) -> DataFrame:
    """Keep the value of each node; its path becomes the names alone.

    A tree's path alternates a name and a container; containers are left out, and so are the
    rows of broken trees.
    """
    require(params, ["path", "value"], "values_only")
    kept = values_at(params, [ATTRIBUTES, VALUE], CHILDREN)
    return kept.drop("error") if "error" in params.columns else kept


def tag(owner: Column, path: Column) -> Column:
    """Owner and path as one string."""
    return F.concat_ws(PATH_SEPARATOR, owner, path)


def split_tag(text: Column) -> Column:
    """A tag as an array: the owner, then the path."""
    return F.split(text, PATH_SEPARATOR)


def without_containers(path: Column) -> Column:
    return F.array_remove(path, CHILDREN)


def lookup(
    params: DataFrame,
    requests: DataFrame,
    keys: list[str],
    strict: bool = False,
) -> DataFrame:
    """Add to each request the value at its path, null if there is none.

    A request may write or omit the containers. ``strict`` fails on a missing path.
    """
    require(params, [*keys, "path", "value"], "lookup")
    require(requests, [*keys, "path"], "lookup")
    canonical = requests.withColumn("_path", without_containers(F.col("path")))
    values = params.select(*keys, F.col("path").alias("_path"), "value")
    found = attach(canonical, too_large_to_copy(values), [*keys, "_path"])
    if strict:
        missing = F.concat(F.lit("no such path: "), F.array_join("_path", PATH_SEPARATOR))
        found = found.withColumn(
            "value", F.coalesce(F.col("value"), F.raise_error(missing).cast("string"))
        )
    return found.drop("_path")


def subtree(
    nodes: DataFrame, requests: DataFrame, keys: list[str], width: int = SUBTREE_BIN
) -> DataFrame:
    """For each request all values at and below the node at its ``path``.

    ``nodes`` are those of ``tree_nodes``; a request may write or omit the containers, which
    are left out of the ``node`` path that comes with each ``value``. A path that is not there,
    or has no values, gives one row with a null node. A path that is written twice gives the
    values of both.

    The requested node's range of numbers is cut into bins of ``width``, and values are found by
    owner and bin, so one owner's large tree spreads over many tasks.
    """
    require(nodes, [*keys, "path", "entry", "leave", "values", "value"], "subtree")
    require(requests, [*keys, "path"], "subtree")
    known = nodes.filter(F.col("path").isNotNull()).select(
        *keys, without_containers(F.col("path")).alias("_path"), "entry", "leave", "values",
        "value", (F.try_element_at("path", F.lit(-1)) == CHILDREN).alias("_container"),
    )
    # a container has the path of its node, which holds it
    ranges = known.filter(~F.col("_container") & (F.col("values") > 0)).select(
        *keys, "_path", "entry", "leave"
    )
    wanted = requests.withColumn("_path", without_containers(F.col("path")))
    bins = F.sequence(
        F.floor(F.col("entry") / F.lit(width)), F.floor((F.col("leave") - 1) / F.lit(width))
    )
    asked = attach(wanted, too_large_to_copy(ranges), [*keys, "_path"]).withColumn("_bin", F.explode_outer(bins))
    leaves = known.filter(F.col("value").isNotNull()).select(
        *keys, F.floor(F.col("entry") / F.lit(width)).alias("_bin"),
        F.col("_path").alias("node"), F.col("entry").alias("_at"), "value",
    )
    inside = (F.col("r._at") >= F.col("l.entry")) & (F.col("r._at") < F.col("l.leave"))
    met = asked.alias("l").join(
        too_large_to_copy(leaves).alias("r"), null_safe([*keys, "_bin"]) & inside, "left"
    )
    return met.filter(F.col("r.node").isNotNull() | F.col("l._bin").isNull()).select(
        *[F.col(f"l.{c}").alias(c) for c in requests.columns], "r.node", "r.value"
    )


def upsert(params: DataFrame, updates: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The latest update of each path, else the present value.

    Any number of updates of one path combines on the map side.
    """
    require(params, [*keys, "path", "value"], "upsert")
    require(updates, [*keys, "path", "value", ts], "upsert")
    present = params.select(
        *keys, "path", "value", F.lit(0).alias("_changed"), F.lit(None).cast(
            updates.schema[ts].dataType
        ).alias("_ts")
    )
    changes = updates.select(
        *keys, "path", "value", F.lit(1).alias("_changed"), F.col(ts).alias("_ts")
    )
    return (
        present.unionByName(changes)
        .groupBy(*keys, "path")
        .agg(F.max_by("value", F.struct("_changed", "_ts", "value")).alias("value"))
    )


def reconcile(known: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Every known path takes its saved value if there is one; other saved paths are
    ignored. Both sides hold a path once, so the join key is unique."""
    require(known, [*keys, "path", "value"], "reconcile")
    require(saved, [*keys, "path", "value"], "reconcile")
    saved_values = saved.select(*keys, "path", F.col("value").alias("_saved"))
    return known.join(too_large_to_copy(saved_values), [*keys, "path"], "left").withColumn(
        "value", F.coalesce("_saved", "value")
    ).drop("_saved")


def unflatten(params: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuild one JSON tree per key from names paths: the inverse of ``values_only``.

    The rows are sorted by key and path, and a tree is written as they stream by, with a stack
    of its open nodes: paths may be of any length. Names are sorted. A path given several times
    gives its name several times; null and empty paths name no node.

    There is a task for each shuffle partition of the session. Adaptive execution would leave about
    one for each core, as rows with paths are shuffled small, so that a task's time would grow with
    the table.
    """
    require(params, [*keys, "path", "value"], "unflatten")
    schema, arrow = _arrow_schema(params, keys, "tree string")
    tasks = int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        params.select(*keys, "path", "value")
        .repartition(tasks, *keys)
        .sortWithinPartitions(*keys, "path", "value")
        .mapInArrow(
            partial(
                tr.written_batches, keys=keys, names=(SAVED_VALUE, SAVED_CHILDREN), schema=arrow
            ),
            schema,
        )
    )


def select_sets(
    requests: DataFrame,
    sets: DataFrame,
    chosen: str,
    default: str,
    name: str = "set_name",
    tree: str = "tree",
) -> DataFrame:
    """The chosen sets of each request in the given order, the default set if none.

    A chosen set without parameters gets an empty tree.
    """
    require(requests, [chosen], "select_sets")
    require(sets, [name, tree], "select_sets")
    rest = [c for c in requests.columns if c != chosen]
    listed = F.when(
        F.size(F.coalesce(F.col(chosen), F.array().cast("array<string>"))) > 0, F.col(chosen)
    ).otherwise(F.array(F.lit(default)))
    picked = requests.select(*rest, F.posexplode_outer(listed).alias("set_ord", name))
    return attach(picked, sets.select(name, tree), [name]).withColumn(tree, F.coalesce(tree, F.lit("{}"))).select(
        *rest, "set_ord", name, tree
    )
