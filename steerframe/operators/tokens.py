"""Token-array operators, and their forms for one token per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steerframe.functions import arrays as ar, text as tx
from steerframe.operators.running import BLOCK, running_sum
from steerframe.operators.skew import attach
from steerframe.schemas import require


def pad_to_longest(
    df: DataFrame,
    group: list[str],
    col: str,
    pad: int,
    side: str = "left",
) -> DataFrame:
    """Pad every array to the longest of its group, on the given side."""
    require(df, [*group, col], "pad_to_longest")
    longest = df.groupBy(*group).agg(F.max(F.size(col)).alias("_longest"))
    return attach(df, longest, group).withColumn(
        col, ar.pad_to(F.col(col), F.col("_longest"), pad, side)
    ).drop("_longest")


def apply_bans(
    candidates: DataFrame,
    requests: DataFrame,
    key: list[str],
    candidate: str,
    ban_csv: str = "ban_csv",
    ban_end: str = "ban_end",
    end_id: int = 0,
) -> DataFrame:
    """Remove each request's banned ids, and the end marker where it asks for that.

    The join key holds the id, so the candidates of one request spread over all tasks.
    """
    require(candidates, [*key, candidate], "apply_bans")
    require(requests, [*key, ban_csv, ban_end], "apply_bans")
    listed = F.transform(
        F.filter(F.split(F.coalesce(F.col(ban_csv), F.lit("")), ","), lambda s: s != ""),
        lambda s: tx.strip(s).cast("long"),
    )
    end = F.when(F.col(ban_end), F.array(F.lit(end_id).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    banned = requests.select(
        *key, F.explode_outer(F.concat(listed, end)).alias(candidate)
    ).filter(F.col(candidate).isNotNull())
    return candidates.join(banned, [*key, candidate], "left_anti")


# Tokens that one hash stands for when sequences are compared.
HASHED_TOKENS = 256


def _block_hashes(tokens: Column, width: int) -> Column:
    """Two hashes for each block of tokens; a null array has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / F.lit(width)), F.lit(1)) - 1)
    return F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(F.slice(tokens, (i * width + 1).cast("int"), F.lit(width))).alias("a"),
            F.xxhash64(F.lit(width), F.slice(tokens, (i * width + 1).cast("int"), F.lit(width))).alias("b"),
        ),
    )


def prefix_reuse(
    seqs: DataFrame,
    key: list[str],
    step: str = "step",
    tokens: str = "tokens",
    row: str | None = None,
    width: int = HASHED_TOKENS,
    block: int = BLOCK,
) -> DataFrame:
    """How much of the previous sequence each step can reuse: ``reused`` and ``new``.

    The previous sequence of a key is that of the step before, however far apart their
    numbers (integers, distinct) are. With batch rows (``row``), a step reuses the shortest
    prefix among them. A sequence that repeats the previous one as a whole still computes its
    last token.

    Steps are numbered by sums over blocks, and neighbours meet by (key, number), so a long
    history spreads over all tasks. What meets first are two hashes for ``width`` tokens; only
    the first block whose hashes differ is then compared token by token.
    """
    by_row = [row] if row else []
    require(seqs, [*key, step, tokens, *by_row], "prefix_reuse")
    own = [*key, *by_row]
    narrow = seqs.select(
        *own, F.col(step).cast("long").alias(step), F.size(tokens).alias("_size"),
        _block_hashes(F.col(tokens), width).alias("_hashes"),
    )
    numbered = running_sum(narrow, own, step, F.lit(1), "_n", block=block).select(
        *own, step, F.col("_n").cast("long").alias("_n"), "_size", "_hashes"
    )
    before = numbered.select(
        *own, (F.col("_n") + 1).alias("_n"), F.col(step).alias("_step_before"),
        F.col("_size").alias("_size_before"), F.col("_hashes").alias("_hashes_before"),
    )
    pair = attach(numbered, before, [*own, "_n"])
    equal_blocks = ar.common_prefix(F.col("_hashes_before"), F.col("_hashes"))
    shared = F.when(
        equal_blocks.isNotNull(), F.least(equal_blocks * F.lit(width), "_size_before", "_size")
    )
    pairs = pair.select(
        *own, step, "_step_before", "_size", shared.alias("_shared"),
        (equal_blocks * F.lit(width)).cast("int").alias("_at"),
    )
    # each sequence gives the block that differs from the one before and from the one behind
    wanted = pairs.filter(F.col("_at").isNotNull()).select(
        *own, F.explode(F.array(
            F.struct(F.col(step).alias(step), F.lit(False).alias("_is_before"), F.col(step).alias("_to")),
            F.struct(F.col("_step_before").alias(step), F.lit(True).alias("_is_before"), F.col(step).alias("_to")),
        )).alias("_w"), "_at",
    ).select(*own, "_w.*", "_at")
    texts = seqs.select(*own, F.col(step).cast("long").alias(step), F.col(tokens).alias("_tokens"))
    pieces = attach(wanted, texts, [*own, step], "inner").select(
        *own, F.col("_to").alias(step), "_is_before",
        F.slice("_tokens", F.col("_at") + 1, F.lit(width)).alias("_piece"),
    )
    # at most two pieces of ``width`` tokens meet
    met = pieces.groupBy(*own, step).agg(
        F.max(F.when(F.col("_is_before"), F.col("_piece"))).alias("_before"),
        F.max(F.when(~F.col("_is_before"), F.col("_piece"))).alias("_own"),
    ).select(*own, step, ar.common_prefix(F.col("_before"), F.col("_own")).alias("_more"))
    joined = attach(pairs, met, [*own, step])
    size = F.col("_size")
    # past the last block that both have, the pieces are empty
    prefix = F.coalesce(F.col("_shared") + F.coalesce("_more", F.lit(0)), F.lit(0))
    per_row = joined.select(*key, step, prefix.alias("_prefix"), size.alias("_size"))
    if row:
        per_row = per_row.groupBy(*key, step).agg(
            F.min("_prefix").alias("_prefix"), F.max("_size").alias("_size")
        )
    reused = F.when(
        (F.col("_prefix") > 0) & (F.col("_prefix") == F.col("_size")), F.col("_prefix") - 1
    ).otherwise(F.col("_prefix"))
    return per_row.select(
        *key, step, reused.alias("reused"), (F.col("_size") - reused).alias("new")
    )


def leader_value(
    df: DataFrame,
    group: list[str],
    order: str,
    col: str,
    out: str | None = None,
) -> DataFrame:
    """All rows of a group take the value of its first row."""
    require(df, [*group, order, col], "leader_value")
    leaders = df.groupBy(*group).agg(F.min_by(col, order).alias("_leader"))
    return attach(df, leaders, group).withColumn(out or col, F.col("_leader")).drop("_leader")


def first_end(tokens: DataFrame, seq: list[str], pos: str, token: str, eos: list[int]):
    """Per sequence: position of its first end marker, null if there is none."""
    at_end = F.when(F.col(token).isin(*eos), F.col(pos))
    return tokens.groupBy(*seq).agg(F.min(at_end).alias("_end"))


def mask_finished(
    tokens: DataFrame,
    seq: list[str],
    eos: list[int],
    pad: int,
    pos: str = "pos",
    token: str = "token",
) -> DataFrame:
    """One token per row: every token after a sequence's first end marker becomes pad.

    The first end is a minimum, combined on the map side, not a window over the
    sequence, so a very long sequence is not sorted in one task.
    """
    require(tokens, [*seq, pos, token], "mask_finished")
    ends = first_end(tokens, seq, pos, token, eos)
    finished = F.coalesce(F.col(pos) > F.col("_end"), F.lit(False))
    return attach(tokens, ends, seq).withColumn(
        token, F.when(finished, F.lit(pad)).otherwise(F.col(token))
    ).drop("_end")


def groups_finished(
    tokens: DataFrame,
    group: list[str],
    seq: list[str],
    eos: list[int],
    pos: str = "pos",
    token: str = "token",
) -> DataFrame:
    """Per group: whether each of its sequences holds an end marker."""
    require(tokens, [*group, *seq, pos, token], "groups_finished")
    keys = [*group, *[c for c in seq if c not in group]]
    ends = first_end(tokens, keys, pos, token, eos)
    return ends.groupBy(*group).agg(
        F.bool_and(F.col("_end").isNotNull()).alias("all_finished")
    )


def mask_finished_arrays(df: DataFrame, col: str, eos: list[int], pad: int) -> DataFrame:
    """The same for one array per sequence."""
    require(df, [col], "mask_finished_arrays")
    return df.withColumn(col, ar.mask_after_end(F.col(col), eos, pad))


def remaining_budget(
    df: DataFrame, col: str, limit: Column, fixed: Column, auto: Column, out: str = "remaining"
) -> DataFrame:
    require(df, [col], "remaining_budget")
    return df.withColumn(out, ar.remaining(F.col(col), limit, fixed, auto))
