"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A plain Python variable would repeat the expression at each use; binding it
    to a lambda argument does not.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def last_of(array: Column) -> Column:
    """Last element, null for an empty array."""
    return F.try_element_at(array, F.lit(-1))
