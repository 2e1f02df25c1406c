"""Page limits on landed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_pages(pages: DataFrame, max_pages: int | None, page_col: str = "page_no", by: Sequence[str] = ()) -> DataFrame:
    """The first max_pages pages of each feed, whose pages are numbered one by one from any start; None keeps all.

    Only the starts are grouped, one number a feed; feeds of a null key are one feed, and pages
    without a number are beyond every limit.
    """
    if max_pages is None:
        return pages
    starts = pages.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(page_col).alias("_start"))
    same = F.col(page_col) < F.col("_start") + max_pages
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return pages.join(starts, same, "left_semi")
