"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.once import packed
from lettermill.functions.storage import cut, shared_dir, steps_to_one_table

__all__ = ["WORD", "cut", "packed", "shared_dir", "steps_to_one_table", "word_count"]

#: A word is a run of characters other than ASCII space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
