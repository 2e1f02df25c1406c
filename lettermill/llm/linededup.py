"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Documents are sequences of lines. A run of consecutive lines of one document with at least
MIN_WORDS words is a repeated run if the same lines stand at an earlier place; places are ordered
by document id, text hash and line number. Every line that lies in a repeated run is deleted. The
first place of a line is never deleted, so each line of the corpus stays somewhere.

Method, in column functions only:
1. Lines get 128-bit ids; lines that occur once cannot lie in a repeated run and split documents
   into segments. Segments under MIN_WORDS words go.
2. Prefix doubling: rank_0 orders the line ids; rank_{k+1} orders the pairs (rank_k[p],
   rank_k[p + 2^k]), with -1 beyond the segment's end. rank_k is the order of the suffixes by their
   first 2^k lines (the inverse suffix array). Pairs are pre-aggregated, range-sorted and numbered
   by monotonically_increasing_id, so no task sees more than a range.
3. Maximal repeated runs are unions of the shortest runs with MIN_WORDS words from each line
   onwards and up to each line. The suffixes that share such a run's n lines form the
   longest-common-prefix interval of depth n: the pair (rank_k[p], rank_k[p + n - 2^k]) with
   2^k <= n < 2^(k+1) names it. Its first place stays, the others are later copies.

The array of adjacent prefix lengths itself is not built: it would need one window over all
suffixes, and the interval names give the same answer by grouping.

Cases: a null text stays null with no lines. An empty text is one empty line. Rows that repeat id
and text are one document and get the same result. Null ids come first in the order. Empty tables
give empty results. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import cut, word_count

#: Words of a run of whole lines from which it counts as repeated; a single line of so many is one, too.
MIN_WORDS = 10


def _ordered(distinct: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Number distinct keys in their order (with gaps) without a global window."""
    return cut(distinct.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(out, F.monotonically_increasing_id()))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    lines = docs.where(text.isNotNull()).select(F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    return lines.select("d", "h", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), word_count(F.col("line")).alias("w"))


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, h, seg, i, w, cs, r0): lines in segments of repeated lines; cs counts words before the line."""
    lines = cut(lines.distinct())
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = _ordered(repeated, ["h1", "h2"], "r0")
    doc = Window.partitionBy("d", "h").orderBy("i")
    rows = lines.join(ids, ["h1", "h2"]).select("d", "h", "i", "w", "r0").withColumn("seg", F.col("i") - F.row_number().over(doc))
    seg = Window.partitionBy("d", "h", "seg")
    before = seg.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("words", F.sum("w").over(seg)).where(F.col("words") >= min_words)
    return cut(rows.withColumn("cs", F.coalesce(F.sum("w").over(before), F.lit(0))).select("d", "h", "seg", "i", "w", "cs", "r0"))


def _shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, h, s, e): from each line the shortest run onwards, and up to each line the shortest run, with min_words words."""

    def events(kind: int, value: Column) -> DataFrame:
        return rows.select("d", "h", "seg", "i", F.lit(kind).alias("kind"), value.alias("v"))

    end = F.col("cs") + F.col("w")
    seg = Window.partitionBy("d", "h", "seg")
    edge = F.last(F.when(F.col("kind") == 0, F.col("i")), ignorenulls=True)
    on = seg.orderBy(F.desc("v"), "kind", F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    onwards = events(0, end).union(events(1, F.col("cs") + min_words)).withColumn("e", edge.over(on)).where("kind = 1 and e is not null").select("d", "h", F.col("i").alias("s"), "e")
    back = seg.orderBy("v", "kind", "i").rowsBetween(Window.unboundedPreceding, 0)
    upto = events(0, F.col("cs")).union(events(1, end - min_words)).withColumn("s", edge.over(back)).where("kind = 1 and s is not null").select("d", "h", "s", F.col("i").alias("e"))
    return onwards.union(upto).distinct()


def suffix_ranks(rows: DataFrame, levels: int) -> DataFrame:
    """Add r1..r<levels>: the order of the suffixes of each segment by their first 2^k lines."""
    for k in range(levels):
        after = F.lead(f"r{k}", 1 << k).over(Window.partitionBy("d", "h", "seg").orderBy("i"))
        pairs = cut(rows.withColumn("b", F.coalesce(after, F.lit(-1))))
        names = _ordered(pairs.groupBy(F.col(f"r{k}").alias("a"), "b").agg(F.count(F.lit(1))), ["a", "b"], f"r{k + 1}")
        rows = pairs.withColumn("a", F.col(f"r{k}")).join(names, ["a", "b"]).drop("a", "b")
    return cut(rows) if levels else rows


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, s, e): maximal stretches of lines s..e (from 0) of document (id d, text hash h) that are later copies."""
    rows = _segments(_lines(docs, id_col, text_col), min_words)
    runs = cut(_shortest_runs(rows, min_words).withColumn("n", F.col("e") - F.col("s") + 1))
    longest = runs.agg(F.max("n")).first()[0] or 1
    levels = longest.bit_length() - 1
    ranks = suffix_ranks(rows, levels)
    ranks = ranks.select("d", "h", "i", F.array(*[f"r{k}" for k in range(levels + 1)]).alias("r"))

    runs = runs.withColumn("k", F.length(F.bin("n")) - 1)
    runs = runs.withColumn("j", F.col("e") + 1 - F.expr("shiftleft(1, k)"))

    def at(runs: DataFrame, place: str, out: str) -> DataFrame:
        there = ranks.select(F.col("d").alias("_d"), F.col("h").alias("_h"), F.col("i").alias("_i"), F.col("r").alias("_r"))
        same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")) & (F.col(place) == F.col("_i"))
        return runs.join(there, same).withColumn(out, F.element_at("_r", F.col("k") + 1)).drop("_d", "_h", "_i", "_r")

    named = cut(at(at(runs, "s", "ra"), "j", "rb").select("d", "h", "s", "e", "n", "ra", "rb"))
    place = F.struct("d", "h", "s")
    intervals = named.groupBy("n", "ra", "rb").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    # as a table of its own the grouping does not tie the join's partitions, and a very common run can be split
    intervals = cut(intervals)
    later = named.join(intervals, ["n", "ra", "rb"]).where(~place.eqNullSafe(F.col("first"))).select("d", "h", "s", "e")

    doc = Window.partitionBy("d", "h").orderBy("s", "e")
    reach = F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("d", "h", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for each row; text without the deleted lines."""
    gone = repeated_runs(docs, id_col, text_col, min_words).groupBy("d", "h").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("_h"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("gone", lambda g: i.between(g["s"], g["e"])))
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda n, g: n + g["e"] - g["s"] + 1), F.lit(0))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
