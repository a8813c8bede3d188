"""The corpus pipeline: documents to packed training sequences, stage by stage.

``STAGES`` lists the stages in order. Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs. All but the last
return the columns of documents. ``run`` applies them to the documents of a folder.

1. toxicity: documents with a toxic score of 0.3 or more go.
2. quality_rules: documents that fail the rules or the quality model go.
3. simhash: one document of each near-duplicate component stays.
4. suffix_dedup: bytes of 100-byte strings that also start earlier go from the texts.
5. packing: texts become token pieces in sequences of 2048.

Stages 1 and 2 learn from the labels of the documents that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steerframe.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from steerframe.llm.catalog import vocabulary
from steerframe.llm.common import materialized, table


def _drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def _keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", _drop_toxic),
    ("quality_rules", _keep_good),
    ("simhash", _keep_one),
    ("suffix_dedup", _cut_repeats),
    ("packing", _pack),
]

# models, fingerprints and token ids cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
