"""Prompt rendering as column expressions.

A role format table says how a message of a role is written. It has one entry per
template and role and is folded into the expressions, so rendering needs no join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from steerframe.functions import text as tx
from steerframe.functions.core import last_of, let

# Marks replaced in a command, modes, and the opening turn that is not
# a user message.
CHARACTER_MARK = "<|character|>"
PROMPT_MARK = "<|prompt|>"
INSTRUCT = "instruct"
CHAT = "chat"
CHAT_INSTRUCT = "chat-instruct"
OPENING_TURN = "<|BEGIN-VISIBLE-CHAT|>"

NAME1_MARK = "<|name1|>"
NAME2_MARK = "<|name2|>"


@dataclass(frozen=True)
class RoleFormat:
    prefix: str
    suffix: str


Formats = Mapping[tuple[str, str], RoleFormat]

DEFAULT_FORMATS: Formats = {
    (CHAT, "system"): RoleFormat("", "\n\n"),
    (CHAT, "user"): RoleFormat(NAME1_MARK + ": ", "\n"),
    (CHAT, "assistant"): RoleFormat(NAME2_MARK + ": ", "\n"),
    (INSTRUCT, "system"): RoleFormat("", "\n\n"),
    (INSTRUCT, "user"): RoleFormat("### Instruction:\n", "\n\n"),
    (INSTRUCT, "assistant"): RoleFormat("### Response:\n", "\n\n"),
}


ROLES = ("system", "user", "assistant")


def role_formats(formats: Formats, template: str, name1: Column, name2: Column) -> Column:
    """One template's formats as a map from role to prefix and suffix, names filled in."""

    def named(literal: str) -> Column:
        out = F.lit(literal)
        if NAME1_MARK in literal:
            out = F.replace(out, F.lit(NAME1_MARK), name1)
        if NAME2_MARK in literal:
            out = F.replace(out, F.lit(NAME2_MARK), name2)
        return out

    entries = []
    for role in ROLES:
        fmt = formats[(template, role)]
        entries += [
            F.lit(role),
            F.struct(named(fmt.prefix).alias("prefix"), named(fmt.suffix).alias("suffix")),
        ]
    return F.create_map(*entries)


def piece(fmt: Column, role: Column, text: Column) -> Column:
    return let(fmt[role], lambda f: F.concat(f["prefix"], text, f["suffix"]))


def pieces(fmt: Column, messages: Column) -> Column:
    """Render an array of messages in its order."""
    return F.array_join(F.transform(messages, lambda m: piece(fmt, m["role"], m["text"])), "")


def chop(text: Column, n: Column) -> Column:
    """Drop the last ``n`` characters."""
    return F.substr(text, F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))


def system_text(mode: Column, char_text: Column, inst_text: Column) -> Column:
    """The system message by mode; null if blank."""
    chosen = F.when(mode == INSTRUCT, inst_text).otherwise(char_text)
    return F.when(~tx.is_blank(chosen), chosen)


def new_user_text(user_input: Column, impersonate: Column, is_continue: Column) -> Column:
    """The new user message, stripped; null if blank, impersonating or continuing."""
    text = tx.strip(user_input)
    return F.when((F.length(text) > 0) & ~impersonate & ~is_continue, text)


def speaker(impersonate: Column) -> Column:
    """The role whose turn the prompt opens."""
    return F.when(impersonate, F.lit("user")).otherwise(F.lit("assistant"))


def opening(prefix: Column) -> Column:
    return F.rtrim(prefix)


def filled_command(command: Column, impersonate: Column, name1: Column, name2: Column) -> Column:
    """The command with its character mark replaced; the prompt mark is still there."""
    who = F.when(impersonate, name1).otherwise(name2)
    return F.replace(command, F.lit(CHARACTER_MARK), who)


def plain_prompt(
    fmt: Column, messages: Column, is_continue: Column, impersonate: Column
) -> Column:
    """Rendered messages with the next turn opened, or the last one left open."""
    turn = fmt[speaker(impersonate)]
    body = pieces(fmt, messages)
    return F.when(is_continue, chop(body, F.length(turn["suffix"]))).otherwise(
        F.concat(body, opening(turn["prefix"]))
    )


def wrapped_prompt(
    chat: Column,
    instruct: Column,
    messages: Column,
    inst_text: Column,
    command: Column,
    user_input: Column,
    is_continue: Column,
    impersonate: Column,
) -> Column:
    """The chat rendering put into a command, in an outer instruction conversation.

    ``command`` has its character filled in. When continuing, the last message is taken
    out of the inner text and opens the outer reply instead.
    """
    inner_messages = F.when(
        is_continue, F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    ).otherwise(messages)
    prefix = chat[speaker(impersonate)]["prefix"]
    reply = F.when(
        is_continue, F.concat(prefix, F.coalesce(last_of(messages)["text"], F.lit("")))
    ).otherwise(opening(prefix))
    outer_system = F.when(
        ~tx.is_blank(inst_text), piece(instruct, F.lit("system"), inst_text)
    ).otherwise(F.lit(""))
    request = F.replace(command, F.lit(PROMPT_MARK), pieces(chat, inner_messages))
    exchange = F.concat(
        piece(instruct, F.lit("user"), request), piece(instruct, F.lit("assistant"), reply)
    )
    outer = F.concat(
        outer_system,
        F.when(user_input.contains(tx.NOCHAT_MARKER), F.lit("")).otherwise(exchange),
    )
    suffix = instruct[F.lit("assistant")]["suffix"]
    return let(outer, lambda text: chop(text, F.length(suffix)))
