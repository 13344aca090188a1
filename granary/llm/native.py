"""Column expressions for the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return let(
        trimmed(text),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+")),
    )


def word_count(text: Column) -> Column:
    """The number of words, as a long."""
    return let(trimmed(text), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS + "+")))).cast("long")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
