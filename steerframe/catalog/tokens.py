"""Token-array queries: word lengths stand for token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steerframe.catalog.common import div, mod, table
from steerframe.functions import arrays as ar
from steerframe.operators import tokens as to

EOS, PAD = 9, 0


def word_lengths(text: str = "text") -> Column:
    return F.transform(F.split(text, " "), lambda w: F.length(w).cast("long"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", word_lengths().alias("tokens"))


_SQL_DOCS = """
d AS (
  SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS tokens
  FROM documents
)"""


def _joined(df: DataFrame, key: str) -> DataFrame:
    """Arrays as text: equal on both engines whatever the array type."""
    return df.select(key, F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


def last_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_tokens(spark, sf_dir)
    return _joined(docs.withColumn("tokens", ar.keep_last(F.col("tokens"), 64)), "doc_id")


SQL_LAST_TOKENS = f"""
WITH {_SQL_DOCS}
SELECT doc_id, array_to_string(tokens[greatest(len(tokens) - 63, 1):], ',') AS tokens FROM d"""


def _pad(rows: DataFrame) -> DataFrame:
    rows = rows.select("conv_id", "turn", word_lengths().alias("tokens"))
    out = to.pad_to_longest(rows, ["conv_id"], "tokens", PAD)
    return out.select(
        "conv_id", "turn", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens")
    )


def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pad(table(spark, sf_dir, "conversations"))


def _with_null_groups(rows: DataFrame, key: str) -> DataFrame:
    """A third of the keys become null: one large group."""
    return rows.withColumn(key, F.when(mod(key, 3) > 0, F.col(key)))


def _sql_with_null_groups(sql: str, table: str, key: str) -> str:
    """The same for a query over one table; its window functions take nulls as one group."""
    changed = f"(SELECT * REPLACE (CASE WHEN {key} % 3 > 0 THEN {key} END AS {key}) FROM {table})"
    return sql.replace(f"FROM {table}", f"FROM {changed}")


def pad_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pad(_with_null_groups(table(spark, sf_dir, "conversations"), "conv_id"))


SQL_PAD = """
WITH c AS (
  SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS tokens
  FROM conversations
),
n AS (SELECT *, max(len(tokens)) OVER (PARTITION BY conv_id) AS longest FROM c)
SELECT conv_id, turn,
  array_to_string(
    list_transform(range(longest - len(tokens)), lambda i: 0) || tokens, ',') AS tokens
FROM n"""


def pad_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large groups (one per language); the shapes only."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", word_lengths().alias("tokens")
    )
    out = to.pad_to_longest(rows, ["lang"], "tokens", 1, "right")
    return out.select(
        "doc_id",
        "lang",
        F.size("tokens").cast("long").alias("n"),
        F.element_at("tokens", -1).alias("last_token"),
    )


SQL_PAD_HOT = """
WITH c AS (
  SELECT doc_id, lang, string_split(text, ' ') AS words, len(string_split(text, ' ')) AS k
  FROM documents
),
n AS (SELECT *, max(k) OVER (PARTITION BY lang) AS n FROM c)
SELECT doc_id, lang, n, CASE WHEN k = n THEN length(words[-1]) ELSE 1 END AS last_token FROM n"""


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_tokens(spark, sf_dir).withColumn(
        "tokens",
        F.concat(
            F.array_repeat(F.lit(7).cast("long"), mod("doc_id", 4).cast("int")), F.col("tokens")
        ),
    )
    return _joined(docs.withColumn("tokens", ar.strip_leading(F.col("tokens"), 7)), "doc_id")


SQL_STRIP = f"""
WITH {_SQL_DOCS}
SELECT doc_id, coalesce(array_to_string(
  tokens[list_position(list_transform(tokens, lambda t: t <> 7), true):], ','), '') AS tokens
FROM d"""


def remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to.remaining_budget(
        document_tokens(spark, sf_dir),
        "tokens",
        F.lit(4096),
        F.lit(200),
        mod("doc_id", 3) != 0,
    )
    return out.select("doc_id", F.col("remaining").cast("long").alias("remaining"))


SQL_REMAINING = f"""
WITH {_SQL_DOCS}
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 4096 - len(tokens) ELSE 200 END AS remaining FROM d"""


def bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    candidates = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    requests = customers.select(
        "c_custkey",
        F.when(mod("c_custkey", 5) == 0, "")
        .otherwise(F.format_string("%d, %d,99", mod("c_custkey", 20), mod("c_custkey", 7)))
        .alias("ban_csv"),
        (mod("c_custkey", 2) == 0).alias("ban_end"),
    )
    out = to.apply_bans(
        candidates.withColumn("i", F.col("i").cast("long")), requests, ["c_custkey"], "i", end_id=2
    )
    return out.withColumnRenamed("i", "cand_id")


SQL_BANS = """
WITH c AS (SELECT c_custkey, unnest(range(20)) AS cand_id FROM customer)
SELECT c_custkey, cand_id FROM c
WHERE NOT (c_custkey % 5 <> 0 AND cand_id IN (c_custkey % 20, c_custkey % 7))
  AND NOT (c_custkey % 2 = 0 AND cand_id = 2)"""


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's sequence: one mark per earlier turn, then its word lengths."""
    marks = F.array_repeat(F.lit(1).cast("long"), (F.col("turn") + mod("conv_id", 3)).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("step"), F.concat(marks, word_lengths()).alias("tokens")
    )


def reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to.prefix_reuse(conversation_steps(spark, sf_dir), ["conv_id"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("reused", "new")})


SQL_REUSE = """
WITH c AS (
  SELECT conv_id, turn AS step,
    list_transform(range(turn + conv_id % 3), lambda i: 1)
      || list_transform(string_split(text, ' '), lambda w: length(w)) AS tokens
  FROM conversations
),
p AS (SELECT *, lag(tokens) OVER (PARTITION BY conv_id ORDER BY step) AS prev FROM c),
n AS (
  SELECT conv_id, step, len(tokens) AS size,
    CASE WHEN prev IS NULL THEN 0 ELSE coalesce(
      list_position(list_transform(range(least(len(prev), len(tokens))),
                                   lambda i: prev[i + 1] <> tokens[i + 1]), true) - 1,
      least(len(prev), len(tokens))) END AS prefix
  FROM p
),
r AS (
  SELECT *, CASE WHEN prefix > 0 AND prefix = size THEN prefix - 1 ELSE prefix END AS reused FROM n
)
SELECT conv_id, step, reused, size - reused AS new FROM r"""


def reuse_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conversations form one batch: the shortest prefix counts."""
    steps = conversation_steps(spark, sf_dir).withColumns(
        {"batch": div("conv_id", 3), "row": mod("conv_id", 3)}
    )
    out = to.prefix_reuse(steps, ["batch"], row="row")
    return out.select("batch", "step", F.col("reused").cast("long").alias("reused"))


SQL_REUSE_BATCH = SQL_REUSE.replace(
    "SELECT conv_id, step, reused, size - reused AS new FROM r",
    """, b AS (
  SELECT conv_id // 3 AS batch, step, min(prefix) AS prefix, max(size) AS size FROM n GROUP BY ALL
)
SELECT batch, step,
       CASE WHEN prefix > 0 AND prefix = size THEN prefix - 1 ELSE prefix END AS reused
FROM b""",
)


def leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    out = to.leader_value(rows, ["conv_id"], "turn", "text", "leader")
    return out.select("conv_id", "turn", "leader")


def leader_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn number in the null group belongs to many rows: a number of its own orders them."""
    rows = table(spark, sf_dir, "conversations").withColumn(
        "place", F.col("conv_id") * 1_000_000 + F.col("turn")
    )
    out = to.leader_value(
        _with_null_groups(rows, "conv_id"), ["conv_id"], "place", "text", "leader"
    )
    return out.select("conv_id", "turn", "place", "leader")


SQL_LEADER = """
SELECT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS leader
FROM conversations"""


SQL_LEADER_NULLS = """
WITH c AS (
  SELECT CASE WHEN conv_id % 3 > 0 THEN conv_id END AS conv_id, turn, text,
         conv_id * 1000000 + turn AS place
  FROM conversations
)
SELECT conv_id, turn, place,
       first_value(text) OVER (PARTITION BY conv_id ORDER BY place) AS leader
FROM c"""


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a sequence of tokens; an error is the end marker."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("batch"),
        "user_id",
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", F.lit(EOS))
        .otherwise(F.length("event_type"))
        .cast("long")
        .alias("token"),
    )


_SQL_EVENT_TOKENS = """
e AS (
  SELECT user_id % 10 AS batch, user_id, event_id AS pos,
         CASE WHEN event_type = 'error' THEN 9 ELSE length(event_type) END AS token
  FROM events
)"""


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to.mask_finished(event_tokens(spark, sf_dir), ["user_id"], [EOS], PAD)
    return out.select("user_id", "pos", F.col("token").cast("long").alias("token"))


def finished_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _with_null_groups(event_tokens(spark, sf_dir), "user_id")
    out = to.mask_finished(tokens, ["user_id"], [EOS], PAD)
    return out.select("user_id", "pos", F.col("token").cast("long").alias("token"))


SQL_FINISHED = f"""
WITH {_SQL_EVENT_TOKENS}
SELECT user_id, pos, CASE WHEN coalesce(bool_or(token = 9) OVER (
    PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  THEN 0 ELSE token END AS token
FROM e"""


def all_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to.groups_finished(event_tokens(spark, sf_dir), ["batch"], ["user_id"], [EOS])


SQL_ALL_FINISHED = f"""
WITH {_SQL_EVENT_TOKENS},
s AS (SELECT batch, user_id, bool_or(token = 9) AS done FROM e GROUP BY ALL)
SELECT batch, bool_and(done) AS all_finished FROM s GROUP BY 1"""


def finished_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = to.mask_finished_arrays(document_tokens(spark, sf_dir), "tokens", [11, 12], PAD)
    return _joined(docs, "doc_id")


SQL_FINISHED_ARRAYS = f"""
WITH {_SQL_DOCS},
p AS (
  SELECT *, coalesce(list_position(
    list_transform(tokens, lambda t: t IN (11, 12)), true), len(tokens)) AS stop
  FROM d
)
SELECT doc_id, array_to_string(
  tokens[:stop] || list_transform(range(len(tokens) - stop), lambda i: 0), ',') AS tokens
FROM p"""


QUERIES = {
    "keep_last": last_tokens,
    "pad_to_longest": pad,
    "pad_to_longest_hot_groups": pad_hot,
    "pad_to_longest_null_groups": pad_nulls,
    "strip_leading": strip,
    "remaining_budget": remaining,
    "apply_bans": bans,
    "prefix_reuse": reuse,
    "prefix_reuse_batch": reuse_batch,
    "leader_value": leader,
    "leader_value_null_groups": leader_nulls,
    "mask_finished": finished,
    "mask_finished_null_groups": finished_nulls,
    "groups_finished": all_finished,
    "mask_finished_arrays": finished_arrays,
}

ORACLES = {
    "keep_last": SQL_LAST_TOKENS,
    "pad_to_longest": SQL_PAD,
    "pad_to_longest_hot_groups": SQL_PAD_HOT,
    "pad_to_longest_null_groups": _sql_with_null_groups(SQL_PAD, "conversations", "conv_id"),
    "strip_leading": SQL_STRIP,
    "remaining_budget": SQL_REMAINING,
    "apply_bans": SQL_BANS,
    "prefix_reuse": SQL_REUSE,
    "prefix_reuse_batch": SQL_REUSE_BATCH,
    "leader_value": SQL_LEADER,
    "leader_value_null_groups": SQL_LEADER_NULLS,
    "mask_finished": SQL_FINISHED,
    "mask_finished_null_groups": SQL_FINISHED.replace(
        "SELECT user_id % 10 AS batch, user_id,",
        "SELECT user_id % 10 AS batch, CASE WHEN user_id % 3 > 0 THEN user_id END AS user_id,",
    ),
    "groups_finished": SQL_ALL_FINISHED,
    "mask_finished_arrays": SQL_FINISHED_ARRAYS,
}
