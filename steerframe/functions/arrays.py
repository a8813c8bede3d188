"""Token arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steerframe.functions.core import let


def keep_last(tokens: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, n)


def pad_to(tokens: Column, length: Column, pad: int, side: str) -> Column:
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side!r}")
    fill = F.array_repeat(F.lit(pad).cast("long"), length - F.size(tokens))
    return F.concat(fill, tokens) if side == "left" else F.concat(tokens, fill)


def _first_true(flags: Column) -> Column:
    """1-based, 0 if there is none."""
    return F.array_position(flags, F.lit(True))


def strip_leading(tokens: Column, marker: int) -> Column:
    """Drop tokens from the front while they equal the marker."""
    first_kept = _first_true(F.transform(tokens, lambda t: t != F.lit(marker)))
    return let(
        first_kept.cast("int"),
        lambda at: F.when(at == 0, F.slice(tokens, F.lit(1), F.lit(0))).otherwise(
            F.slice(tokens, F.greatest(at, F.lit(1)), F.size(tokens))
        ),
    )


def remaining(tokens: Column, limit: Column, fixed: Column, auto: Column) -> Column:
    """What is left of the limit, or the fixed maximum when not automatic."""
    return F.when(auto, limit - F.size(tokens)).otherwise(fixed)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; null if an array is null."""

    def counted(shorter: Column) -> Column:
        differs = F.zip_with(
            F.slice(a, F.lit(1), shorter),
            F.slice(b, F.lit(1), shorter),
            lambda x, y: x != y,
        )
        return let(
            _first_true(differs).cast("int"),
            lambda at: F.when(at == 0, shorter).otherwise(at - 1),
        )

    both = a.isNotNull() & b.isNotNull()
    return F.when(both, let(F.least(F.size(a), F.size(b)), counted))


def mask_after_end(tokens: Column, eos: list[int], pad: int) -> Column:
    """Every token after the first end marker becomes pad."""
    first_end = _first_true(F.transform(tokens, lambda t: t.isin(*eos)))
    return let(
        first_end,
        lambda at: F.when(at == 0, tokens).otherwise(
            F.transform(
                tokens, lambda t, i: F.when(i >= at, F.lit(pad).cast("long")).otherwise(t)
            )
        ),
    )
