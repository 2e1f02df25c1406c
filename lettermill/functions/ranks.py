"""Ranks and running totals within groups of any size, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.once import packed
from lettermill.functions.storage import cut

#: About so many rows share a range, and as few as this where cores would be idle.
ROWS_PER_RANGE, LEAST_ROWS = 20_000, 500


def running_total(df: DataFrame, group: str, key: str, ties: list[str], value: str | Column, out: str) -> DataFrame:
    """Add `out`, in place of a column of that name: the total of `value` over the group's rows before this one, by (key, ties).

    The rows are written with the number of their task, and those that agree in group, key, ties,
    value and task are counted. Ranges of about ROWS_PER_RANGE of these counts are dealt by the
    whole order, so neither a large group nor a common key, nor a row that is often repeated, falls
    to one task; the ranges' totals, one row each, give the offsets. Equal rows are numbered within
    their task. Columns of df cannot clash with those used here.
    """
    value = F.col(value) if isinstance(value, str) else value
    order = ["g", "k", "t", "v", "part"]
    at = F.struct(*[F.col(c) for c in ties]) if ties else F.lit(0)
    rows = cut(packed(df, g=F.col(group), k=F.col(key), t=at, v=value.cast("long"), part=F.spark_partition_id()).withColumn("tie", F.xxhash64(*order)))
    counts = rows.groupBy("tie", *order).agg(F.count(F.lit(1)).alias("n"))
    n = rows.count()
    ranges = max(-(-n // ROWS_PER_RANGE), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), 1)
    dealt = cut(counts.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    total = F.col("v") * F.col("n")
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("g", "range").agg(F.sum(total).alias("total"))
    offsets = cut(offsets.select(F.col("g").alias("og"), F.col("range").alias("orange"), F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("offset")))
    inside = Window.partitionBy("g", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum(total).over(inside), F.lit(0)).cast("long"))
    placed = placed.join(offsets, F.col("g").eqNullSafe(F.col("og")) & (F.col("range") == F.col("orange")))
    placed = cut(placed.select(F.struct("tie", *order).alias("whole"), F.col("tie").alias("of"), (F.col("offset") + F.col("inside")).alias("before")))
    nth = F.row_number().over(Window.partitionBy("tie", *order).orderBy(F.lit(1))) - 1
    joined = rows.join(placed, (F.col("tie") == F.col("of")) & F.struct("tie", *order).eqNullSafe(F.col("whole")))
    joined = joined.select("row", (F.col("before") + F.col("v") * nth).cast("long").alias("out"))
    return joined.select(*[F.col(f"row.`{c}`") for c in df.columns if c != out], F.col("out").alias(out))


def group_ranks(df: DataFrame, group: str, key: str, ties: list[str], out: str) -> DataFrame:
    """Add `out`: the number of the group's rows before this one, by (key, ties)."""
    return running_total(df, group, key, ties, F.lit(1), out)
