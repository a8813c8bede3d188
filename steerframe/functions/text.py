"""Section text as column expressions.

A context is one string that may hold ``[[NAME]]`` headers. Everything about one
context is computed inside its row, as an array of sections: no explode and no
regrouping, hence no shuffle however large or skewed the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steerframe.functions.core import last_of, let

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Section names with a meaning, and the header a bare text gets.
POSITIVE = "POSITIVE"
NEGATIVE = "NEGATIVE"
SHARED = "SHARED"
SHARED_HEADER = "[[SHARED]]\n"

# Markers taken out of a finished prompt.
NOCHAT_MARKER = "<|nochat|>"
CHAT_MARKER = "<|chat|>"

# A text starting like this is left alone; any other is put under SHARED. The name
# part is looser here than in HEADER: it may contain a bracket.
STARTS_WITH_HEADER = r"(?d)^\[\[.*?\]\]\n"
HEADER = r"^\[\[([^\]]+)\]\]\n"
# One piece: an optional header, then whole lines up to a newline that a header
# follows. Possessive, so that matching a long text needs no backtracking stack.
PIECE = r"(?:\[\[[^\]]+\]\]\n)?[^\n]*+(?:\n(?!\[\[[^\]]+\]\]\n)[^\n]*+)*+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def with_default_header(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(STARTS_WITH_HEADER), text).otherwise(
        F.concat(F.lit(SHARED_HEADER), text)
    )


def sections(body: Column) -> Column:
    """``array<struct<ord, name, text>>`` of a text that went through the default header.

    A repeated name keeps its first place and takes its last text.
    """
    pieces = F.filter(
        F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)), lambda piece: piece.rlike(HEADER)
    )

    def named(piece: Column) -> Column:
        header_name = F.regexp_extract(piece, HEADER, 1)
        return F.struct(
            strip(F.upper(header_name)).alias("name"),
            # the header is [[ + name + ]] + newline: the text starts five characters on
            F.substr(piece, F.length(header_name) + F.lit(6)).alias("text"),
        )

    def in_first_seen_order(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda s: s["name"]))
        return F.transform(
            names,
            lambda name, i: F.struct(
                i.alias("ord"),
                name.alias("name"),
                last_of(F.filter(found, lambda s: s["name"] == name))["text"].alias("text"),
            ),
        )

    return let(F.transform(pieces, named), in_first_seen_order)


def _text_of(found: Column, name: str) -> Column:
    return F.get(F.filter(found, lambda s: s["name"] == name), F.lit(0))["text"]


def _extras(found: Column, stem: str) -> Column:
    return F.transform(
        F.filter(found, lambda s: s["name"].startswith(stem) & (s["name"] != stem)),
        lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text")),
    )


def _without_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def resolve(found: Column, body: Column) -> Column:
    """Pick the main positive and negative text; the rest of each family are extras.

    With no exact main section the extra inserted last takes its place. A positive
    then falls back to the shared text and at last to the whole body; a negative
    to the empty string.
    """
    main_positive, main_negative = _text_of(found, POSITIVE), _text_of(found, NEGATIVE)
    pos_extras, neg_extras = _extras(found, POSITIVE), _extras(found, NEGATIVE)
    return F.struct(
        F.coalesce(
            main_positive, last_of(pos_extras)["text"], _text_of(found, SHARED), body
        ).alias("positive"),
        F.coalesce(main_negative, last_of(neg_extras)["text"], F.lit("")).alias("negative"),
        F.when(main_positive.isNotNull(), pos_extras)
        .otherwise(_without_last(pos_extras))
        .alias("positive_extras"),
        F.when(main_negative.isNotNull(), neg_extras)
        .otherwise(_without_last(neg_extras))
        .alias("negative_extras"),
    )


def expand(resolved: Column, found: Column) -> Column:
    """Replace ``{{NAME}}`` by section texts, one pass in section order.

    An inner reference is resolved only if its section comes later in the text.
    """

    def filled(text: Column) -> Column:
        return F.aggregate(
            found,
            text,
            lambda acc, s: F.replace(
                acc, F.concat(F.lit("{{"), s["name"], F.lit("}}")), s["text"]
            ),
        )

    def filled_extras(extras: Column) -> Column:
        return F.transform(
            extras, lambda e: F.struct(e["name"].alias("name"), filled(e["text"]).alias("text"))
        )

    return F.struct(
        filled(resolved["positive"]).alias("positive"),
        filled(resolved["negative"]).alias("negative"),
        filled_extras(resolved["positive_extras"]).alias("positive_extras"),
        filled_extras(resolved["negative_extras"]).alias("negative_extras"),
    )


def _merge_extras(char_extras: Column, inst_extras: Column, char_main: Column, inst_main: Column):
    char_names = F.transform(char_extras, lambda e: e["name"])

    def side(name: Column, char_text: Column, inst_text: Column) -> Column:
        return F.struct(
            name.alias("name"), char_text.alias("char_text"), inst_text.alias("inst_text")
        )

    from_char = F.transform(
        char_extras,
        lambda e: side(
            e["name"],
            e["text"],
            F.coalesce(
                F.get(F.filter(inst_extras, lambda o: o["name"] == e["name"]), F.lit(0))["text"],
                inst_main,
            ),
        ),
    )
    only_inst = F.transform(
        F.filter(inst_extras, lambda e: ~F.array_contains(char_names, e["name"])),
        lambda e: side(e["name"], char_main, e["text"]),
    )
    return F.concat(from_char, only_inst)


def merge(char: Column, inst: Column) -> Column:
    """Full outer merge by section name of two expanded contexts of one row.

    A missing side takes that context's main text. A character negative with no
    instruction negative pulls in the instruction positive, not vice versa.
    """
    inst_negative = F.when(
        (F.length(char["negative"]) > 0) & (F.length(inst["negative"]) == 0), inst["positive"]
    ).otherwise(inst["negative"])
    return F.struct(
        char["positive"].alias("char_positive"),
        inst["positive"].alias("inst_positive"),
        char["negative"].alias("char_negative"),
        inst_negative.alias("inst_negative"),
        _merge_extras(
            char["positive_extras"], inst["positive_extras"], char["positive"], inst["positive"]
        ).alias("positive_extras"),
        _merge_extras(
            char["negative_extras"], inst["negative_extras"], char["negative"], inst_negative
        ).alias("negative_extras"),
    )


def variants(merged: Column) -> Column:
    """Main positive, positive extras, negative extras, then the main negative if any."""

    def row(polarity: str, name: Column, char_text: Column, inst_text: Column) -> Column:
        return F.struct(
            F.lit(polarity).alias("polarity"),
            name.alias("name"),
            char_text.alias("char_text"),
            inst_text.alias("inst_text"),
        )

    def extras(polarity: str, array: Column) -> Column:
        return F.transform(
            array, lambda e: row(polarity, e["name"], e["char_text"], e["inst_text"])
        )

    main_negative = F.array(
        row("negative", F.lit(NEGATIVE), merged["char_negative"], merged["inst_negative"])
    )
    has_negative = (
        F.length(merged["char_negative"]) + F.length(merged["inst_negative"])
    ) > 0
    return F.concat(
        F.array(
            row("positive", F.lit(POSITIVE), merged["char_positive"], merged["inst_positive"])
        ),
        extras("positive", merged["positive_extras"]),
        extras("negative", merged["negative_extras"]),
        F.filter(main_negative, lambda _: has_negative),
    )


def without_markers(text: Column) -> Column:
    cleaned = F.replace(
        F.replace(text, F.lit(NOCHAT_MARKER), F.lit("")), F.lit(CHAT_MARKER), F.lit("")
    )
    return F.when(text.contains(NOCHAT_MARKER), cleaned).otherwise(text)
