"""Conversation queries over ``conversations``: one spec per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steerframe.catalog.common import mod, pick, table
from steerframe.operators import convo as cn
from steerframe.plans.prompts import build_prompts, first_builder

COMMAND = "Write <|character|>'s next line.\n<|prompt|>\nStay in role."


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, some turns with stray blanks, empty or an opening sentinel."""
    text = (
        F.when((mod("conv_id", 10) == 0) & (F.col("turn") == 0), "<|BEGIN-VISIBLE-CHAT|>")
        .when((F.col("conv_id") + F.col("turn")) % 11 == 0, " \t\n")
        .otherwise(F.concat(F.lit("\t"), F.col("text"), F.lit(" \n")))
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("spec_id"), "turn", "role", text.alias("text")
    )


_SQL_MESSAGES = """
m AS (
  SELECT conv_id AS spec_id, turn, role,
    CASE WHEN conv_id % 10 = 0 AND turn = 0 THEN '<|BEGIN-VISIBLE-CHAT|>'
         WHEN (conv_id + turn) % 11 = 0 THEN ' ' || chr(9) || chr(10)
         ELSE chr(9) || text || chr(160) || chr(10) END AS raw
  FROM conversations
),
h AS (
  SELECT spec_id, turn, role, trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text
  FROM m
  WHERE trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''
    AND NOT (role = 'user' AND raw = '<|BEGIN-VISIBLE-CHAT|>')
)"""


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per conversation, of every mode and flag, with small budgets."""
    openings = table(spark, sf_dir, "conversations").filter(F.col("turn") == 0)
    conv = F.col("conv_id")
    return openings.select(
        conv.alias("spec_id"),
        F.when(F.col("role") == "system", F.col("text"))
        .when(conv % 9 == 0, "  ")
        .otherwise("You are a guide.\n")
        .alias("char_text"),
        F.when(conv % 6 == 0, " ").otherwise("Answer briefly.").alias("inst_text"),
        F.when(conv % 13 == 0, "hush <|nochat|>")
        .when(conv % 4 == 0, "")
        .otherwise("  go on ")
        .alias("user_input"),
        pick(conv % 3, "instruct", "chat", "chat-instruct").alias("mode"),
        F.lit("Ann").alias("name1"),
        F.concat(F.lit("Bot"), (conv % 5).cast("string")).alias("name2"),
        F.lit(COMMAND).alias("command"),
        (conv % 17 * 170 + 20).alias("max_len"),
        (conv % 5 == 0).alias("is_continue"),
        (conv % 7 == 0).alias("impersonate"),
    )


_SQL_SPECS = f"""
s AS (
  SELECT conv_id AS spec_id,
    CASE WHEN role = 'system' THEN text WHEN conv_id % 9 = 0 THEN '  '
         ELSE 'You are a guide.' || chr(10) END AS char_text,
    CASE WHEN conv_id % 6 = 0 THEN ' ' ELSE 'Answer briefly.' END AS inst_text,
    CASE WHEN conv_id % 13 = 0 THEN 'hush <|nochat|>' WHEN conv_id % 4 = 0 THEN ''
         ELSE '  go on ' END AS user_input,
    ['instruct', 'chat', 'chat-instruct'][conv_id % 3 + 1] AS mode,
    'Ann' AS name1, 'Bot' || conv_id % 5 AS name2,
    replace('{COMMAND.replace("'", "''")}', '<|character|>',
            CASE WHEN conv_id % 7 = 0 THEN 'Ann' ELSE 'Bot' || conv_id % 5 END) AS command,
    conv_id % 17 * 170 + 20 AS max_len,
    conv_id % 5 = 0 AS is_continue, conv_id % 7 = 0 AS impersonate
  FROM conversations WHERE turn = 0
),
t AS (
  SELECT *, CASE mode WHEN 'instruct' THEN 'instruct' ELSE 'chat' END AS template,
    CASE WHEN mode = 'instruct' THEN inst_text ELSE char_text END AS sys,
    CASE WHEN trim(user_input) <> '' AND NOT impersonate AND NOT is_continue
         THEN trim(user_input) END AS input
  FROM s
)"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.clean_turns(messages(spark, sf_dir))


SQL_CLEAN = f"WITH {_SQL_MESSAGES} SELECT spec_id, turn, role, text FROM h"


def system_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.choose_system_text(specs(spark, sf_dir)).select("spec_id", "mode", "system_text")


SQL_SYSTEM_TEXT = f"""
WITH {_SQL_SPECS}
SELECT spec_id, mode, CASE WHEN trim(sys, ' ' || chr(10)) <> '' THEN sys END AS system_text
FROM t"""


def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cn.assemble_messages(specs(spark, sf_dir), messages(spark, sf_dir), ["spec_id"])
    return out.withColumn("part", F.col("part").cast("long"))


_SQL_ASSEMBLED = f"""
WITH {_SQL_MESSAGES}, {_SQL_SPECS},
a AS (
  SELECT spec_id, 0 AS part, 0 AS turn, 'system' AS role, sys AS text FROM t
  WHERE trim(sys, ' ' || chr(10)) <> ''
  UNION ALL
  SELECT spec_id, 1, turn, role, text FROM h WHERE role IN ('user', 'assistant')
  UNION ALL
  SELECT spec_id, 2, 0, 'user', input FROM t WHERE input IS NOT NULL
)"""

SQL_ASSEMBLE = (
    _SQL_ASSEMBLED + " SELECT spec_id, part::BIGINT AS part, turn, role, text FROM a"
)

# Every state of dropping messages one by one, with its whole prompt; the first that
# fits is the answer. State i drops the i oldest, the state after that the system row.
_SQL_STATES = (
    _SQL_ASSEMBLED
    + """,
f(template, role, pre, suf) AS (
  VALUES ('chat', 'system', '', chr(10) || chr(10)), ('chat', 'user', 'Ann: ', chr(10)),
         ('chat', 'assistant', '<2>: ', chr(10)),
         ('instruct', 'system', '', chr(10) || chr(10)),
         ('instruct', 'user', '### Instruction:' || chr(10), chr(10) || chr(10)),
         ('instruct', 'assistant', '### Response:' || chr(10), chr(10) || chr(10))
),
l AS (
  SELECT a.spec_id,
    list({'part': part, 'turn': turn, 'role': a.role, 'text': text,
          'piece': replace(f.pre, '<2>', t.name2) || text || f.suf} ORDER BY part, turn)
      AS msgs
  FROM a JOIN t USING (spec_id) JOIN f ON f.template = t.template AND f.role = a.role
  GROUP BY 1
),
n AS (
  SELECT t.*, coalesce(l.msgs, []) AS msgs,
         list_filter(coalesce(l.msgs, []), lambda x: x.part = 0) AS first_msgs,
         list_filter(coalesce(l.msgs, []), lambda x: x.part > 0) AS rest,
         o.pre AS open_pre_raw, o.suf AS open_suf
  FROM t LEFT JOIN l USING (spec_id)
  JOIN f o ON o.template = t.template
    AND o.role = CASE WHEN t.impersonate THEN 'user' ELSE 'assistant' END
),
st AS (SELECT *, unnest(range(len(rest) + 2)) AS i FROM n),
kept AS (
  SELECT *, CASE WHEN i > len(rest) THEN [] ELSE first_msgs || rest[i + 1:] END AS k,
         replace(open_pre_raw, '<2>', name2) AS open_pre
  FROM st
),
shown AS (
  SELECT *, array_to_string(list_transform(k, lambda x: x.piece), '') AS body,
    array_to_string(list_transform(CASE WHEN is_continue THEN k[:-2] ELSE k END,
                                   lambda x: x.piece), '') AS inner_body
  FROM kept
),
p AS (
  SELECT spec_id, mode, is_continue, max_len, i, k, CASE WHEN mode = 'chat-instruct' THEN
      left(outer_text, length(outer_text) - 2)
    WHEN is_continue THEN left(body, greatest(length(body) - length(open_suf), 0))
    ELSE body || rtrim(open_pre, ' ') END AS prompt
  FROM (
    SELECT *,
      CASE WHEN trim(inst_text) <> '' THEN inst_text || chr(10) || chr(10) ELSE '' END
      || CASE WHEN contains(user_input, '<|nochat|>') THEN ''
         ELSE '### Instruction:' || chr(10) || replace(command, '<|prompt|>', inner_body)
              || chr(10) || chr(10) || '### Response:' || chr(10)
              || CASE WHEN is_continue THEN open_pre || coalesce(k[-1].text, '')
                      ELSE rtrim(open_pre, ' ') END
              || chr(10) || chr(10) END AS outer_text
    FROM shown
  )
),
best AS (
  SELECT * FROM p
  QUALIFY row_number() OVER (
    PARTITION BY spec_id ORDER BY (length(prompt) <= max_len OR len(k) = 0) DESC, i
  ) = 1
)"""
)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cn.kept_rows(specs(spark, sf_dir), messages(spark, sf_dir), ["spec_id"], block=3)
    return out.withColumn("part", F.col("part").cast("long"))


SQL_KEPT = (
    _SQL_STATES
    + """
SELECT spec_id, m.part::BIGINT AS part, m.turn AS turn, m.role AS role, m.text AS text
FROM (SELECT spec_id, unnest(k) AS m FROM best)"""
)


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and characters that each prompt keeps."""
    out = cn.truncate_to_budget(specs(spark, sf_dir), messages(spark, sf_dir), ["spec_id"])
    total = F.aggregate(
        "messages", F.lit(0), lambda acc, m: acc + F.length(m["text"])
    )
    return out.select(
        "spec_id", F.size("messages").cast("long").alias("n"), total.cast("long").alias("chars")
    )


SQL_FITTED = (
    _SQL_STATES
    + """
SELECT spec_id, len(k) AS n,
       coalesce(list_sum(list_transform(k, lambda x: length(x.text))), 0)::BIGINT AS chars
FROM best JOIN s USING (spec_id)"""
)


def _prompts(spark: SparkSession, sf_dir: str, wanted) -> DataFrame:
    fit = cn.truncate_to_budget(
        specs(spark, sf_dir).filter(wanted), messages(spark, sf_dir), ["spec_id"]
    )
    return cn.render_prompt(fit).select("spec_id", "mode", "prompt")


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(
        spark, sf_dir, (F.col("mode") != "chat-instruct") & ~F.col("is_continue")
    )


def render_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, (F.col("mode") != "chat-instruct") & F.col("is_continue"))


def wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, F.col("mode") == "chat-instruct")


def _sql_prompts(condition: str) -> str:
    return _SQL_STATES + f" SELECT spec_id, mode, prompt FROM best WHERE {condition}"


def prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole job, in all modes: tagged contexts to variants to fitted prompts."""
    tagged = specs(spark, sf_dir).withColumns(
        {
            "char_context": F.concat(
                F.lit("[[BASE]]\n"), F.col("char_text"),
                F.lit("\n[[POSITIVE]]\n{{BASE}} Be kind.\n[[NEGATIVE]]\n{{BASE}} Be rude."),
            ),
            "inst_context": F.col("inst_text"),
        }
    )
    out = build_prompts(tagged.drop("char_text", "inst_text"), messages(spark, sf_dir))
    return out.select(
        "spec_id",
        F.col("batch_idx").cast("long").alias("batch_idx"),
        "polarity",
        "prompt",
        F.size("messages").cast("long").alias("n_messages"),
    )


# the states of every variant: each has a number of its own in place of the spec's
SQL_PROMPT_BATCH = (
    _SQL_STATES.replace("\ns AS (", "\ns0 AS (")
    .replace(
        "),\nt AS (",
        """),
s AS (
  SELECT s0.* REPLACE (spec_id * 2 + b AS spec_id, char_text || tail AS char_text)
  FROM s0, (VALUES (0, ' Be kind.'), (1, ' Be rude.')) v(b, tail)
),
t AS (""",
    )
    .replace(
        "FROM h WHERE",
        "FROM (SELECT h.* REPLACE (spec_id * 2 + b AS spec_id) FROM h, range(2) w(b)) WHERE",
    )
    + """
SELECT spec_id // 2 AS spec_id, spec_id % 2 AS batch_idx,
       ['positive', 'negative'][spec_id % 2 + 1] AS polarity, prompt, len(k) AS n_messages
FROM best"""
)


def _last_words(specs: DataFrame, messages: DataFrame) -> DataFrame:
    """A user's prompt builder: the last user message of a conversation, asked again."""
    last = (
        cn.clean_turns(messages).filter("role = 'user'")
        .groupBy("spec_id").agg(F.max_by("text", "turn").alias("text"))
    )
    asked = F.concat("name1", F.lit(" asked: "), F.coalesce("text", F.lit("nothing")))
    return specs.select("spec_id", "name1").join(last, "spec_id", "left").select(
        "spec_id", asked.alias("prompt")
    )


def user_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chosen set that has a prompt builder of its own gives the prompts."""
    build = first_builder(["plain", "last words", "other"], {"last words": _last_words})
    return build(specs(spark, sf_dir), messages(spark, sf_dir))


SQL_USER_BUILDER = f"""
WITH {_SQL_MESSAGES}, {_SQL_SPECS},
l AS (SELECT spec_id, arg_max(text, turn) AS text FROM h WHERE role = 'user' GROUP BY 1)
SELECT spec_id, name1 || ' asked: ' || coalesce(text, 'nothing') AS prompt
FROM s LEFT JOIN l USING (spec_id)"""


QUERIES = {
    "clean_turns": clean,
    "choose_system_text": system_text,
    "assemble_messages": assemble,
    "kept_rows": kept,
    "truncate_to_budget": fitted,
    "render_prompt": render,
    "render_prompt_continued": render_continued,
    "wrap_chat_instruct": wrap,
    "prompt_batch": prompt_batch,
    "user_prompt_builder": user_builder,
}

ORACLES = {
    "clean_turns": SQL_CLEAN,
    "choose_system_text": SQL_SYSTEM_TEXT,
    "assemble_messages": SQL_ASSEMBLE,
    "kept_rows": SQL_KEPT,
    "truncate_to_budget": SQL_FITTED,
    "render_prompt": _sql_prompts("mode <> 'chat-instruct' AND NOT is_continue"),
    "render_prompt_continued": _sql_prompts("mode <> 'chat-instruct' AND is_continue"),
    "wrap_chat_instruct": _sql_prompts("mode = 'chat-instruct'"),
    "prompt_batch": SQL_PROMPT_BATCH,
    "user_prompt_builder": SQL_USER_BUILDER,
}
