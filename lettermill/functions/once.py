"""Columns that are computed once a row, however often later columns and filters name them, and rows kept apart from helper columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add the columns, in place of those of the same name, behind a step that the optimizer does not merge with others.

    Projections are merged by copying their expressions into every place that uses them, and
    filters move below them. A generator of one row is neither copied nor passed.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df as one struct `row`, with columns beside it whose names clash with none of the row's."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])
