"""Column types shared by the operators, and the input check they all use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

SECTION = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

CURVE_POINT = T.StructType(
    [
        T.StructField("depth", T.DoubleType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("skip_before", T.BooleanType()),
        T.StructField("skip_after", T.BooleanType()),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("sib_ord", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("shape", T.ArrayType(CURVE_POINT)),
    ]
)

SETTING = T.StructType(
    [
        T.StructField("set_ord", T.IntegerType()),
        T.StructField("layer_idx", T.LongType()),
        T.StructField("site", T.StringType()),
        T.StructField("func", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

PARAM = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("value", T.StringType()),
    ]
)

CHOSEN_SET = T.StructType(
    [
        T.StructField("set_ord", T.IntegerType()),
        T.StructField("owner", T.StringType()),
    ]
)


def require(df: DataFrame, columns: Iterable[str], operator: str) -> None:
    """Fail before any job starts when an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{operator}: missing columns {missing}; got {df.columns}")
