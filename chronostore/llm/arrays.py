"""Small building blocks for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda's body is evaluated for each element, and so is every whole
    expression that it mentions; a variable of an outer lambda is not.
    """
    return F.transform(F.array(value), body)[0]


def indices(array: Column) -> Column:
    """0 .. size - 1; empty for an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    shorter = F.least(F.size(a), F.size(b))
    first = F.array_min(F.filter(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i) != F.get(b, i)))
    return F.coalesce(first, shorter)
