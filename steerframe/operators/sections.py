"""Section operators: parse, resolve, expand, merge and fan out contexts.

All of them are narrow. Only ``parse_sections`` and ``fan_out_variants`` change the
number of rows, by exploding an array built in the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steerframe.functions import text as tx
from steerframe.functions.core import let
from steerframe.schemas import require


def with_sections(df: DataFrame, text_col: str, out: str = "sections") -> DataFrame:
    require(df, [text_col], "with_sections")
    return df.withColumn(out, tx.sections(tx.with_default_header(F.col(text_col))))


def parse_sections(df: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """One row per section: the keys, ``ord``, ``name`` and ``text``."""
    require(df, [text_col, *key_cols], "parse_sections")
    # The outer form: for the inner one Spark infers a non-empty filter and pushes it
    # below the projection, which would parse every text a second time.
    listed = with_sections(df, text_col).select(*key_cols, F.inline_outer("sections"))
    return listed.filter(F.col("ord").isNotNull())


def resolve_sections(df: DataFrame, text_col: str, out: str = "resolved") -> DataFrame:
    """Add the struct of main and extra texts, placeholders still in place."""
    require(df, [text_col], "resolve_sections")
    body = tx.with_default_header(F.col(text_col))
    return df.withColumn(
        out, let(body, lambda b: let(tx.sections(b), lambda found: tx.resolve(found, b)))
    )


def expand_placeholders(df: DataFrame, text_col: str, out: str = "expanded") -> DataFrame:
    """Add the struct of main and extra texts with every placeholder filled in."""
    require(df, [text_col], "expand_placeholders")
    body = tx.with_default_header(F.col(text_col))

    def filled(found, b):
        return let(tx.resolve(found, b), lambda resolved: tx.expand(resolved, found))

    return df.withColumn(
        out, let(body, lambda b: let(tx.sections(b), lambda found: filled(found, b)))
    )


def merge_contexts(
    df: DataFrame, char_col: str = "char", inst_col: str = "inst", out: str = "merged"
) -> DataFrame:
    """Merge two expanded contexts of the same row by section name."""
    require(df, [char_col, inst_col], "merge_contexts")
    return df.withColumn(out, tx.merge(F.col(char_col), F.col(inst_col)))


def fan_out_variants(df: DataFrame, merged_col: str = "merged") -> DataFrame:
    """One row per prompt variant, numbered ``batch_idx`` 0..n-1, with the batch counts."""
    require(df, [merged_col], "fan_out_variants")
    rest = [c for c in df.columns if c != merged_col]
    listed = df.withColumn("_variants", tx.variants(F.col(merged_col)))
    counted = listed.withColumn(
        "numpos", F.size(F.filter("_variants", lambda v: v["polarity"] == "positive"))
    ).withColumn("numneg", F.size("_variants") - F.col("numpos"))
    # never empty, so the outer form only keeps Spark from inferring a filter on it
    return counted.select(
        *rest, "numpos", "numneg", F.posexplode_outer("_variants").alias("batch_idx", "_v")
    ).select(*rest, "batch_idx", "_v.*", "numpos", "numneg")


def prompt_variants(
    specs: DataFrame, char_col: str = "char_context", inst_col: str = "inst_context"
) -> DataFrame:
    """Specs to variants in one pass: parse, resolve, expand, merge, fan out."""
    require(specs, [char_col, inst_col], "prompt_variants")
    both = expand_placeholders(
        expand_placeholders(specs, char_col, "_char"), inst_col, "_inst"
    )
    merged = merge_contexts(both, "_char", "_inst", "_merged")
    return fan_out_variants(
        merged.drop(char_col, inst_col, "_char", "_inst"), "_merged"
    )


def strip_markers(df: DataFrame, col: str) -> DataFrame:
    require(df, [col], "strip_markers")
    return df.withColumn(col, tx.without_markers(F.col(col)))
