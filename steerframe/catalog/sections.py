"""Section queries: tagged contexts put around the texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steerframe.catalog.common import mod, table
from steerframe.operators import sections as so


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of character context and four of instruction context."""
    text, lang = F.col("text"), F.col("lang")

    def joined(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    char_kinds = [
        text,
        joined(
            "[[SHARED]]\n", text, "\n[[ positive ]]\nBe {{SHARED}} in {{LANG}}",
            "\n[[NEGATIVE]]\nNot {{SHARED}}\n[[LANG]]\n", lang,
        ),
        joined(
            "[[POSITIVE A]]\n", text, "\n[[POSITIVE B]]\nB of {{POSITIVE A}}",
            "\n[[NEGATIVE 2]]\nno ", lang, "\n[[NEGATIVE 3]]\nnone",
        ),
        joined("[[NEGATIVE]]\n\n[[NEGATIVE 2]]\n", lang),
        joined("[[X]]\n", text, "\n[[x]]\n", lang, "\n[[POSITIVE]]\nuse {{X}} and {{Y}}"),
        joined("[[a]b]]\n", text),
    ]
    inst_kinds = [
        F.lit(""),
        F.lit("Be brief"),
        F.lit("[[POSITIVE]]\nip\n[[POSITIVE A]]\nia\n[[NEGATIVE 2]]\nin2\n[[NEGATIVE]]\n"),
        F.lit("[[POSITIVE C]]\nc {{S}}\n[[S]]\nss\n[[NEGATIVE]]\nineg"),
    ]

    def by(column: str, kinds):
        out = kinds[0]
        for i, kind in enumerate(kinds[1:], 1):
            out = F.when(F.col(column) == i, kind).otherwise(out)
        return out

    return (
        table(spark, sf_dir, "documents")
        .withColumn("_char", mod("doc_id", 6))
        .withColumn("_inst", F.floor(F.col("doc_id") / 6) % 4)
        .select(
            "doc_id",
            by("_char", char_kinds).alias("char_context"),
            by("_inst", inst_kinds).alias("inst_context"),
        )
    )


def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = so.parse_sections(contexts(spark, sf_dir), "char_context", ["doc_id"])
    return out.withColumn("ord", F.col("ord").cast("long"))


_SQL_DOCS = "d AS (SELECT doc_id, doc_id % 6 AS c, doc_id // 6 % 4 AS k, text, lang FROM documents)"

SQL_PARSE = f"""
WITH {_SQL_DOCS},
s AS (
  SELECT doc_id, unnest(CASE c
    WHEN 0 THEN [{{'ord': 0, 'name': 'SHARED', 'text': text}}]
    WHEN 1 THEN [{{'ord': 0, 'name': 'SHARED', 'text': text}},
                 {{'ord': 1, 'name': 'POSITIVE', 'text': 'Be {{{{SHARED}}}} in {{{{LANG}}}}'}},
                 {{'ord': 2, 'name': 'NEGATIVE', 'text': 'Not {{{{SHARED}}}}'}},
                 {{'ord': 3, 'name': 'LANG', 'text': lang}}]
    WHEN 2 THEN [{{'ord': 0, 'name': 'POSITIVE A', 'text': text}},
                 {{'ord': 1, 'name': 'POSITIVE B', 'text': 'B of {{{{POSITIVE A}}}}'}},
                 {{'ord': 2, 'name': 'NEGATIVE 2', 'text': 'no ' || lang}},
                 {{'ord': 3, 'name': 'NEGATIVE 3', 'text': 'none'}}]
    WHEN 3 THEN [{{'ord': 0, 'name': 'NEGATIVE', 'text': ''}},
                 {{'ord': 1, 'name': 'NEGATIVE 2', 'text': lang}}]
    WHEN 4 THEN [{{'ord': 0, 'name': 'X', 'text': lang}},
                 {{'ord': 1, 'name': 'POSITIVE', 'text': 'use {{{{X}}}} and {{{{Y}}}}'}}]
    ELSE [] END) AS s FROM d
)
SELECT doc_id, s.ord::BIGINT AS ord, s.name AS name, s.text AS text FROM s"""


def _mains(df: DataFrame, col: str) -> DataFrame:
    names = F.array_join(F.transform(F.col(col)["positive_extras"], lambda e: e["name"]), ",")
    neg_names = F.array_join(F.transform(F.col(col)["negative_extras"], lambda e: e["name"]), ",")
    return df.select(
        "doc_id",
        F.col(col)["positive"].alias("positive"),
        F.col(col)["negative"].alias("negative"),
        names.alias("positive_extras"),
        neg_names.alias("negative_extras"),
    )


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mains(so.resolve_sections(contexts(spark, sf_dir), "char_context"), "resolved")


SQL_RESOLVE = f"""
WITH {_SQL_DOCS}
SELECT doc_id,
  CASE c WHEN 0 THEN text WHEN 1 THEN 'Be {{{{SHARED}}}} in {{{{LANG}}}}'
    WHEN 2 THEN 'B of {{{{POSITIVE A}}}}'
    WHEN 3 THEN '[[NEGATIVE]]' || chr(10) || chr(10) || '[[NEGATIVE 2]]' || chr(10) || lang
    WHEN 4 THEN 'use {{{{X}}}} and {{{{Y}}}}'
    ELSE '[[a]b]]' || chr(10) || text END AS positive,
  CASE c WHEN 1 THEN 'Not {{{{SHARED}}}}' WHEN 2 THEN 'none' ELSE '' END AS negative,
  CASE c WHEN 2 THEN 'POSITIVE A' ELSE '' END AS positive_extras,
  CASE c WHEN 2 THEN 'NEGATIVE 2' WHEN 3 THEN 'NEGATIVE 2' ELSE '' END AS negative_extras
FROM d"""


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mains(so.expand_placeholders(contexts(spark, sf_dir), "char_context"), "expanded")


# the same after replacement
_SQL_CHAR = """
  SELECT doc_id, k, text, lang, c,
    CASE c WHEN 0 THEN text WHEN 1 THEN 'Be ' || text || ' in ' || lang
      WHEN 2 THEN 'B of ' || text
      WHEN 3 THEN '[[NEGATIVE]]' || chr(10) || chr(10) || '[[NEGATIVE 2]]' || chr(10) || lang
      WHEN 4 THEN 'use ' || lang || ' and {{Y}}'
      ELSE '[[a]b]]' || chr(10) || text END AS positive,
    CASE c WHEN 1 THEN 'Not ' || text WHEN 2 THEN 'none' ELSE '' END AS negative
  FROM d"""

SQL_EXPAND = f"""
WITH {_SQL_DOCS}, e AS ({_SQL_CHAR})
SELECT doc_id, positive, negative,
  CASE c WHEN 2 THEN 'POSITIVE A' ELSE '' END AS positive_extras,
  CASE c WHEN 2 THEN 'NEGATIVE 2' WHEN 3 THEN 'NEGATIVE 2' ELSE '' END AS negative_extras
FROM e"""


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = so.expand_placeholders(
        so.expand_placeholders(contexts(spark, sf_dir), "char_context", "char"),
        "inst_context",
        "inst",
    )
    merged = so.merge_contexts(both)
    extras = F.concat(F.col("merged.positive_extras"), F.col("merged.negative_extras"))
    return merged.select("doc_id", F.posexplode_outer(extras).alias("ord", "e")).filter(
        F.col("e").isNotNull()
    ).select(
        "doc_id", F.col("ord").cast("long").alias("ord"), "e.name", "e.char_text", "e.inst_text"
    )


# Extras of both sides by construction, merged by a full outer join.
_SQL_MERGE = f"""
WITH {_SQL_DOCS}, char_main AS ({_SQL_CHAR}),
inst_main AS (
  SELECT doc_id,
    CASE k WHEN 0 THEN '' WHEN 1 THEN 'Be brief' WHEN 2 THEN 'ip' ELSE 'c ss' END AS positive,
    CASE k WHEN 3 THEN 'ineg' ELSE '' END AS own_negative
  FROM d
),
main AS (
  SELECT c.doc_id, c.positive AS char_pos, i.positive AS inst_pos, c.negative AS char_neg,
         CASE WHEN c.negative <> '' AND i.own_negative = '' THEN i.positive
              ELSE i.own_negative END AS inst_neg
  FROM char_main c JOIN inst_main i USING (doc_id)
),
char_extra AS (
  SELECT doc_id, 0 AS cls, 0 AS ord, 'POSITIVE A' AS name, text FROM d WHERE c = 2
  UNION ALL SELECT doc_id, 1, 0, 'NEGATIVE 2', 'no ' || lang FROM d WHERE c = 2
  UNION ALL SELECT doc_id, 1, 0, 'NEGATIVE 2', lang FROM d WHERE c = 3
),
inst_extra AS (
  SELECT doc_id, 0 AS cls, 0 AS ord, 'POSITIVE A' AS name, 'ia' AS text FROM d WHERE k = 2
  UNION ALL SELECT doc_id, 1, 0, 'NEGATIVE 2', 'in2' FROM d WHERE k = 2
),
extra AS (
  SELECT doc_id, cls, name, coalesce(c.ord, 100 + i.ord) AS ord,
         c.text AS char_text, i.text AS inst_text
  FROM char_extra c FULL JOIN inst_extra i USING (doc_id, cls, name)
),
merged AS (
  SELECT e.doc_id, e.cls, e.name, e.ord,
    coalesce(e.char_text, CASE e.cls WHEN 0 THEN m.char_pos ELSE m.char_neg END) AS char_text,
    coalesce(e.inst_text, CASE e.cls WHEN 0 THEN m.inst_pos ELSE m.inst_neg END) AS inst_text
  FROM extra e JOIN main m USING (doc_id)
)"""

SQL_MERGE = (
    _SQL_MERGE
    + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cls, ord) - 1 AS ord,
       name, char_text, inst_text
FROM merged"""
)


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.prompt_variants(contexts(spark, sf_dir)).withColumns(
        {c: F.col(c).cast("long") for c in ("batch_idx", "numpos", "numneg")}
    )


SQL_FAN_OUT = (
    _SQL_MERGE
    + """,
v AS (
  SELECT doc_id, -1 AS cls, 0 AS ord, 'positive' AS polarity, 'POSITIVE' AS name,
         char_pos AS char_text, inst_pos AS inst_text FROM main
  UNION ALL
  SELECT doc_id, cls, ord, ['positive', 'negative'][cls + 1], name, char_text, inst_text
  FROM merged
  UNION ALL
  SELECT doc_id, 2, 0, 'negative', 'NEGATIVE', char_neg, inst_neg
  FROM main WHERE char_neg <> '' OR inst_neg <> ''
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cls, ord) - 1 AS batch_idx,
       polarity, name, char_text, inst_text,
       count(*) FILTER (polarity = 'positive') OVER (PARTITION BY doc_id) AS numpos,
       count(*) FILTER (polarity = 'negative') OVER (PARTITION BY doc_id) AS numneg
FROM v"""
)


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.when(mod("doc_id", 2) == 0, "<|nochat|>").otherwise(""),
            F.col("text"),
            F.when(mod("doc_id", 3) == 0, "<|chat|><|nochat|>").otherwise("<|chat|>"),
        ).alias("text"),
    )
    return so.strip_markers(marked, "text")


SQL_MARKERS = """
SELECT doc_id,
  text || CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN '' ELSE '<|chat|>' END AS text
FROM documents"""


QUERIES = {
    "parse_sections": parse,
    "resolve_sections": resolve,
    "expand_placeholders": expand,
    "merge_contexts": merge,
    "fan_out_variants": fan_out,
    "strip_markers": markers,
}

ORACLES = {
    "parse_sections": SQL_PARSE,
    "resolve_sections": SQL_RESOLVE,
    "expand_placeholders": SQL_EXPAND,
    "merge_contexts": SQL_MERGE,
    "fan_out_variants": SQL_FAN_OUT,
    "strip_markers": SQL_MARKERS,
}
