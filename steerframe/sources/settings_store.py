"""Saved settings as JSON.

Two forms: flat rows (the ordered choice of sets and the parameter rows), and documents
``{"chips": [set, ...], "params": {owner: tree}}``, in which a node of a tree holds its
``value`` and its children under ``sub``. A document may hold everything or, as written here,
the choice or one owner alone; those of one folder are read together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from steerframe.operators.params import (
    SAVED_CHILDREN, SAVED_VALUE, flatten_params, unflatten, values_at,
)
from steerframe.schemas import CHOSEN_SET, PARAM, require

_CHOSEN, _PARAMS = "chosen", "params"

# Names of a settings document.
CHIPS, PARAMS = "chips", "params"


def write_params(params: DataFrame, path: str, by_owner: bool = False) -> None:
    """Write parameter rows as JSON lines, one writer per partition.

    ``by_owner`` lays the files out in a folder per owner, for a few large owners.
    """
    require(params, PARAM.names, "write_params")
    writer = params.select(*PARAM.names).write.mode("overwrite")
    (writer.partitionBy("owner") if by_owner else writer).json(f"{path}/{_PARAMS}")


def write_chosen(chosen: DataFrame, path: str) -> None:
    """Write the ordered choice of sets."""
    require(chosen, CHOSEN_SET.names, "write_chosen")
    chosen.select(*CHOSEN_SET.names).write.mode("overwrite").json(f"{path}/{_CHOSEN}")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    # a line that is no settings row comes back empty
    return rows.filter(F.col("owner").isNotNull())


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Saved parameter rows; none if nothing was saved there."""
    return _read(spark, f"{path}/{_PARAMS}", PARAM)


def read_chosen(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/{_CHOSEN}", CHOSEN_SET)


def write_documents(params: DataFrame, chosen: DataFrame, path: str) -> None:
    """Write settings as documents, one line for the choice of sets and one for each owner.

    Every owner's tree is put together and written by the task that has its rows.
    """
    require(params, PARAM.names, "write_documents")
    require(chosen, CHOSEN_SET.names, "write_documents")
    quoted = F.expr("substr(to_json(array(owner)), 2, length(to_json(array(owner))) - 2)")
    trees = unflatten(params, ["owner"]).select(
        F.concat(F.lit(f'{{"{PARAMS}":{{'), quoted, F.lit(":"), "tree", F.lit("}}")).alias("value")
    )
    # the choice is a short list that a person makes
    names = F.array_sort(F.collect_list(F.struct("set_ord", "owner")))["owner"]
    choice = chosen.agg(names.alias("names")).select(
        F.concat(F.lit(f'{{"{CHIPS}":'), F.to_json("names"), F.lit("}")).alias("value")
    )
    trees.unionByName(choice).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All values of the documents: ``document`` (a number), ``path``, ``value``, ``error``.

    A line that is no document gives one row with its text and the reason, so that nothing is
    lost unseen. ``document_params``, ``document_choice`` and ``broken_documents`` are the parts.
    """
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("document"), F.col("value").alias("_line")
    )
    return flatten_params(lines.filter(F.trim("_line") != ""), "_line", ["document"])


def document_params(documents: DataFrame) -> DataFrame:
    """The parameter rows of all owners."""
    saved = documents.filter((F.get("path", F.lit(0)) == PARAMS) & (F.size("path") > 3)).select(
        F.get("path", F.lit(1)).alias("owner"),
        F.slice("path", F.lit(3), F.greatest(F.size("path") - 2, F.lit(0))).alias("path"),
        "value",
    )
    return values_at(saved, [SAVED_VALUE], SAVED_CHILDREN)


def document_choice(documents: DataFrame) -> DataFrame:
    """The chosen sets in order."""
    chips = documents.filter((F.size("path") == 1) & (F.get("path", F.lit(0)) == CHIPS))
    return chips.select(
        F.posexplode(F.from_json("value", "array<string>")).alias("set_ord", "owner")
    ).select(*CHOSEN_SET.names)


def broken_documents(documents: DataFrame) -> DataFrame:
    """The lines that are no documents, and why; their count is the number lost."""
    return documents.filter(F.col("error").isNotNull()).select("document", "value", "error")
