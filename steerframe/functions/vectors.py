"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F

from steerframe.functions.core import let

# Fixed value: what padded tail components are set to.
MASKED_SCORE = -65504.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def square_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(square_sum(a))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def subtract_scaled(a: Column, b: Column, factor: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - factor * y)


def log_sum_exp(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: top
        + F.ln(F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
    )


def mask_tail(vec: Column, n: Column | int) -> Column:
    """Set the last ``n`` components to the masked score."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(
        vec, lambda x, i: F.when(i >= F.size(vec) - n, F.lit(MASKED_SCORE)).otherwise(x)
    )


def split(vec: Column, heads: int) -> Column:
    """``array<array<double>>``: the vector cut into ``heads`` equal parts."""
    width = (F.size(vec) / F.lit(heads)).cast("int")
    return let(
        width,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(vec, h * w + 1, w)
        ),
    )


def angle(a: Column, b: Column) -> Column:
    """Angle in radians; null if a vector has length zero."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


# Widest vector that is summed one component per aggregate.
WIDE = 256


def weighted_sum(vec: str, weight: str, dim: int | None) -> Column:
    """Aggregate: the sum of ``weight * vec`` of two columns, combined on the map side.

    With a known, moderate dimension it is one plain sum per component, a hash
    aggregate in generated code. Otherwise the vector summarizer, which takes any
    length and is about twice as slow.
    """
    if dim is not None and dim <= WIDE:
        # as one parsed expression: a Python call per component would take longer than
        # the query on small data
        sums = ", ".join(f"sum(get(`{vec}`, {i}) * `{weight}`)" for i in range(dim))
        return F.expr(f"array({sums})")
    scaled = array_to_vector(scale(F.col(vec), F.col(weight)))
    return vector_to_array(Summarizer.sum(scaled))
