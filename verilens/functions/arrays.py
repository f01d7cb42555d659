"""Binding and barrier helpers for heavy array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add heavy columns behind a generator of one row.

    Filters on a projected column are pushed below the projection by copying its
    expression, and a copy inside a lambda would run per element. Nothing is
    pushed through a generator, so each column here is computed once per row.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
