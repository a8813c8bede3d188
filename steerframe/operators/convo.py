"""Conversation operators: clean, assemble, fit to a length budget, render.

A *spec* is one prompt to build (a variant of a context); its conversation's history
is shared by all its variants. Budgets are worked out on block totals of the history,
so that only the newest messages of a conversation are ever moved with their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from steerframe.functions import chat as ch, text as tx
from steerframe.operators.running import BLOCK, block_of
from steerframe.operators.skew import attach
from steerframe.schemas import require

Cost = Callable[[Column], Column]

SPEC_COLUMNS = [
    "char_text",
    "inst_text",
    "user_input",
    "mode",
    "name1",
    "name2",
    "command",
    "max_len",
    "is_continue",
    "impersonate",
]

# Where a message stands in its prompt: before, within or after the history.
SYSTEM_PART, HISTORY_PART, INPUT_PART = 0, 1, 2

_MESSAGES = "array<struct<turn:bigint,role:string,text:string>>"


def clean_turns(
    messages: DataFrame, role: str = "role", text: str = "text"
) -> DataFrame:
    """Strip texts; drop empty turns and the user's opening sentinel."""
    require(messages, [role, text], "clean_turns")
    stripped = messages.withColumn(text, tx.strip(F.col(text)))
    opening = (F.col(role) == "user") & (F.col(text) == ch.OPENING_TURN)
    return stripped.filter((F.length(text) > 0) & ~opening)


def _history(messages: DataFrame, conv: str) -> DataFrame:
    require(messages, [conv, "turn", "role", "text"], "history")
    return clean_turns(messages).filter(F.col("role").isin("user", "assistant")).select(
        conv, F.col("turn").cast("long").alias("turn"), "role", "text"
    )


def choose_system_text(specs: DataFrame, out: str = "system_text") -> DataFrame:
    """Instruct mode takes the instruction text, any other the context; blank is null."""
    require(specs, ["mode", "char_text", "inst_text"], "choose_system_text")
    return specs.withColumn(
        out, ch.system_text(F.col("mode"), F.col("char_text"), F.col("inst_text"))
    )


def _with_own_messages(specs: DataFrame) -> DataFrame:
    return choose_system_text(specs).withColumn(
        "user_text",
        ch.new_user_text(F.col("user_input"), F.col("impersonate"), F.col("is_continue")),
    )


def assemble_messages(
    specs: DataFrame,
    messages: DataFrame,
    keys: list[str],
    conv: str = "spec_id",
) -> DataFrame:
    """Message rows of each spec: system, history in order, new user message.

    Rows are ordered by (``part``, ``turn``), taken from the input rather than counted
    by a window. One spec per conversation; with several, use ``truncate_to_budget``.
    """
    require(specs, [*keys, conv, *SPEC_COLUMNS], "assemble_messages")
    own = _with_own_messages(specs)
    columns = [*keys, "part", "turn", "role", "text"]

    def from_spec(part: int, role: str, text: str) -> DataFrame:
        return own.filter(F.col(text).isNotNull()).select(
            *keys,
            F.lit(part).alias("part"),
            F.lit(0).cast("long").alias("turn"),
            F.lit(role).alias("role"),
            F.col(text).alias("text"),
        )

    keyed = specs.select(conv, *[k for k in keys if k != conv])
    history = (
        attach(_history(messages, conv), keyed, [conv], "inner")
        .withColumn("part", F.lit(HISTORY_PART))
        .select(*columns)
    )
    return (
        from_spec(SYSTEM_PART, "system", "system_text")
        .unionByName(history)
        .unionByName(from_spec(INPUT_PART, "user", "user_text"))
    )


def _with_formats(specs: DataFrame, formats: ch.Formats) -> DataFrame:
    """Add the formats of both templates and of the one that renders the history."""
    name1, name2 = F.col("name1"), F.col("name2")
    both = specs.withColumns(
        {
            "_chat": ch.role_formats(formats, ch.CHAT, name1, name2),
            "_instruct": ch.role_formats(formats, ch.INSTRUCT, name1, name2),
            "_command": ch.filled_command(F.col("command"), F.col("impersonate"), name1, name2),
        }
    )
    return both.withColumn(
        "_format",
        F.when(F.col("mode") == ch.INSTRUCT, F.col("_instruct")).otherwise(F.col("_chat")),
    )


def _budgets(specs: DataFrame, formats: ch.Formats, cost: Cost) -> DataFrame:
    """Everything about a prompt's length that does not depend on the history."""
    columns = [*specs.columns, "system_text", "user_text"]
    own = _with_formats(_with_own_messages(specs), formats)
    template, outer = F.col("_format"), F.col("_instruct")
    is_continue = F.col("is_continue")

    def over(fmt: Column, role: str) -> Column:
        f = fmt[F.lit(role)]
        return cost(f["prefix"]) + cost(f["suffix"])

    turn = template[ch.speaker(F.col("impersonate"))]
    bare_command = F.replace("_command", F.lit(ch.PROMPT_MARK), F.lit(""))
    measured = own.select(
        *columns,
        (F.col("mode") == ch.CHAT_INSTRUCT).alias("_wrapped"),
        F.col("user_input").contains(tx.NOCHAT_MARKER).alias("_silent"),
        over(template, "user").alias("_user_over"),
        over(template, "assistant").alias("_assistant_over"),
        over(template, "system").alias("_system_over"),
        F.coalesce(cost(F.col("system_text")), F.lit(0)).alias("_system_len"),
        cost(F.col("user_text")).alias("_user_len"),
        F.when(is_continue, cost(turn["prefix"]))
        .otherwise(cost(ch.opening(turn["prefix"])))
        .alias("_opened"),
        cost(turn["suffix"]).alias("_turn_suffix"),
        (cost(bare_command) + over(outer, "user") + over(outer, "assistant")).alias("_request"),
        ((F.length("_command") - F.length(bare_command)) / F.lit(len(ch.PROMPT_MARK)))
        .cast("int")
        .alias("_mentions"),
        F.when(tx.is_blank(F.col("inst_text")), F.lit(0))
        .otherwise(over(outer, "system") + cost(F.col("inst_text")))
        .alias("_outer_system"),
        cost(outer[F.lit("assistant")]["suffix"]).alias("_outer_suffix"),
    )
    wrapped, silent = F.col("_wrapped"), F.col("_silent")
    exchange = F.when(silent, F.lit(0)).otherwise(F.col("_request") + F.col("_opened"))
    sized = measured.select(
        *columns,
        "_user_over",
        "_assistant_over",
        "_system_len",
        # how often the rendered history appears in the prompt
        F.when(~wrapped, F.lit(1))
        .when(silent, F.lit(0))
        .otherwise(F.col("_mentions"))
        .alias("_repeat"),
        # a continued wrapped prompt shows its last message once, outside the history
        (wrapped & is_continue).alias("_last_outside"),
        F.when(silent, F.lit(0)).otherwise(F.lit(1)).alias("_last_shown"),
        F.when(wrapped, F.col("_outer_system") + exchange - F.col("_outer_suffix"))
        .when(is_continue, -F.col("_turn_suffix"))
        .otherwise(F.col("_opened"))
        .alias("_fixed"),
        F.when(F.col("system_text").isNull(), F.lit(0))
        .otherwise(F.col("_system_over"))
        .alias("_system_over"),
        F.coalesce(F.col("_user_len") + F.col("_user_over"), F.lit(0)).alias("_input_cost"),
    )
    system_inside = F.col("_repeat") * (F.col("_system_len") + F.col("_system_over"))
    system_alone = F.when(
        F.col("_last_outside"), F.col("_last_shown") * F.col("_system_len")
    ).otherwise(system_inside)
    return sized.withColumns(
        {
            "_keeps_system": F.col("system_text").isNotNull()
            & (F.col("_fixed") + system_alone <= F.col("max_len")),
            "_room": F.col("max_len") - F.col("_fixed") - system_inside,
            "_input_cost": F.col("_repeat") * F.col("_input_cost"),
        }
    ).withColumn(
        "_keeps_input",
        F.col("user_text").isNotNull() & (F.col("_input_cost") <= F.col("_room")),
    )


def _message_over() -> Column:
    return F.when(F.col("role") == "user", F.col("_user_over")).otherwise(
        F.col("_assistant_over")
    )


def kept_history(
    budgets: DataFrame,
    messages: DataFrame,
    keys: list[str],
    conv: str,
    cost: Cost,
    block: int = BLOCK,
    shown_only: bool = False,
) -> DataFrame:
    """History rows that fit, newest first, for specs with worked-out budgets.

    Costs are not negative, so a message is kept exactly if all from it to the newest
    fit. Per conversation and block of turns, text costs are pre-aggregated; a block
    whose newer blocks already exceed the room is dropped before any text moves, and
    the rest is summed inside blocks, so no task holds more than a block.

    A prompt that shows no history has room for all of it. With ``shown_only`` such a
    spec keeps just the newest message, which a continued prompt still shows.
    """
    history = _history(messages, conv).withColumn("_block", block_of(F.col("turn"), block))
    is_user = F.col("role") == "user"
    blocks = history.groupBy(conv, "_block").agg(
        F.sum(cost(F.col("text"))).alias("_text_cost"),
        F.count_if(is_user).alias("_users"),
        F.count_if(~is_user).alias("_assistants"),
        # plain numbers, so that this stays a hash aggregate
        F.max_by(is_user, F.col("turn")).alias("_newest_is_user"),
        F.max_by(cost(F.col("text")), F.col("turn")).alias("_newest_len"),
    )
    # a prompt that cannot keep its new user message keeps no history either
    open_specs = budgets.filter(
        F.col("user_text").isNull() | F.col("_keeps_input")
    ).select(
        *keys,
        *[c for c in [conv] if c not in keys],
        "_repeat",
        "_last_outside",
        "_last_shown",
        "_user_over",
        "_assistant_over",
        (F.col("_room") - F.col("_input_cost")).alias("_room"),
    )
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("_block"))
    newer = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    block_cost = F.col("_repeat") * (
        F.col("_text_cost")
        + F.col("_users") * F.col("_user_over")
        + F.col("_assistants") * F.col("_assistant_over")
    )
    newest_over = F.when(F.col("_newest_is_user"), F.col("_user_over")).otherwise(
        F.col("_assistant_over")
    )
    # the newest message is in every kept run, so showing it elsewhere is a constant
    moved = F.when(
        F.col("_last_outside"),
        F.col("_last_shown") * F.col("_newest_len")
        - F.col("_repeat") * (F.col("_newest_len") + newest_over),
    ).otherwise(F.lit(0))
    open_blocks = (
        open_specs.join(blocks, conv)
        .withColumn("_newer", F.coalesce(F.sum(block_cost).over(newer), F.lit(0)))
        .withColumn("_newest_is_user", F.first("_newest_is_user").over(newest_first))
        .withColumn("_newest_len", F.first("_newest_len").over(newest_first))
        .withColumn("_room", F.col("_room") - moved)
        .filter(F.col("_newer") <= F.col("_room"))
        .drop("_text_cost", "_users", "_assistants", "_newest_is_user", "_newest_len")
    )
    if shown_only:
        unseen = F.col("_repeat") == 0
        open_blocks = open_blocks.withColumn(
            "_newest_block", F.max("_block").over(Window.partitionBy(*keys))
        ).filter(~unseen | (F.col("_block") == F.col("_newest_block")))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.desc("turn"))
    message_cost = F.col("_repeat") * (cost(F.col("text")) + _message_over())
    fitting = (
        open_blocks.join(history, [conv, "_block"])
        .withColumn(
            "_upto",
            F.col("_newer")
            + F.sum(message_cost).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .filter(F.col("_upto") <= F.col("_room"))
    )
    if shown_only:
        fitting = fitting.withColumn("_rank", F.row_number().over(inside)).filter(
            ~unseen | (F.col("_rank") == 1)
        )
    return fitting.select(*keys, "turn", "role", "text")


def kept_rows(
    specs: DataFrame,
    messages: DataFrame,
    keys: list[str],
    conv: str = "spec_id",
    formats: ch.Formats = ch.DEFAULT_FORMATS,
    cost: Cost = F.length,
    block: int = BLOCK,
) -> DataFrame:
    """The messages a prompt keeps after truncation, one per row."""
    require(specs, [*keys, conv, *SPEC_COLUMNS], "kept_rows")
    budgets = _budgets(specs, formats, cost)

    def own(part: int, role: str, text: str, kept: str) -> DataFrame:
        return budgets.filter(F.col(kept)).select(
            *keys,
            F.lit(part).alias("part"),
            F.lit(0).cast("long").alias("turn"),
            F.lit(role).alias("role"),
            F.col(text).alias("text"),
        )

    history = kept_history(budgets, messages, keys, conv, cost, block).select(
        *keys, F.lit(HISTORY_PART).alias("part"), "turn", "role", "text"
    )
    return (
        own(SYSTEM_PART, "system", "system_text", "_keeps_system")
        .unionByName(history)
        .unionByName(own(INPUT_PART, "user", "user_text", "_keeps_input"))
    )


def truncate_to_budget(
    specs: DataFrame,
    messages: DataFrame,
    keys: list[str],
    conv: str = "spec_id",
    formats: ch.Formats = ch.DEFAULT_FORMATS,
    cost: Cost = F.length,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``messages``, the array a prompt keeps: as many of the newest as fit.

    Oldest messages go first and the system message last; if it does not fit alone,
    nothing is left. A history that the prompt does not show costs nothing and is kept
    whole, as ``kept_rows`` does.
    """
    require(specs, [*keys, conv, *SPEC_COLUMNS], "truncate_to_budget")
    budgets = _budgets(specs, formats, cost)
    kept = (
        kept_history(budgets, messages, keys, conv, cost, block, shown_only=False)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_kept"))
    )

    def single(role: str, text: str, condition: str) -> Column:
        message = F.struct(
            F.lit(0).cast("long").alias("turn"),
            F.lit(role).alias("role"),
            F.col(text).alias("text"),
        )
        return F.when(F.col(condition), F.array(message)).otherwise(F.array().cast(_MESSAGES))

    joined = budgets.join(kept, keys, "left")
    return joined.withColumn(
        "messages",
        F.concat(
            single("system", "system_text", "_keeps_system"),
            F.coalesce("_kept", F.array().cast(_MESSAGES)),
            single("user", "user_text", "_keeps_input"),
        ),
    ).select(*specs.columns, "messages")


def render_prompt(
    specs: DataFrame,
    messages: str = "messages",
    formats: ch.Formats = ch.DEFAULT_FORMATS,
    out: str = "prompt",
) -> DataFrame:
    """Write a spec's messages as one prompt with the next turn opened.

    Chat-instruct specs are wrapped in their command; continued ones leave the last
    message open.
    """
    require(specs, [messages, *SPEC_COLUMNS], "render_prompt")
    ready = _with_formats(specs, formats)
    is_continue, impersonate = F.col("is_continue"), F.col("impersonate")
    plain = ch.plain_prompt(F.col("_format"), F.col(messages), is_continue, impersonate)
    wrapped = ch.wrapped_prompt(
        F.col("_chat"),
        F.col("_instruct"),
        F.col(messages),
        F.col("inst_text"),
        F.col("_command"),
        F.col("user_input"),
        is_continue,
        impersonate,
    )
    return ready.withColumn(
        out, F.when(F.col("mode") == ch.CHAT_INSTRUCT, wrapped).otherwise(plain)
    ).select(*specs.columns, out)
