"""Evaluate a costly expression once.

Catalyst copies a column's expression into every filter that is pushed below it, and
shares repeated expressions only where all uses are unconditional. For regular
expressions over whole texts that multiplies the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator: filters on them stay above it."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
