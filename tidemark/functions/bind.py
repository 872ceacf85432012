"""Computing an expression once.

Catalyst inlines a column's definition into every filter above it and evaluates it anew at each
mention inside conditional branches. For cheap expressions that is right; these helpers are for
regular expressions over long texts, JSON access and url resolution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once. For small values: the body is interpreted."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed here and nowhere else.

    They come out of a one-row generator, through which filters on them are not pushed. It stays
    inside whole-stage code generation.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
