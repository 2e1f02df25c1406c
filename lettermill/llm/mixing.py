"""Mix sources to target weights with exact token budgets.

Every document gets the hash-random key md5(doc_id). Within a source, documents are range-dealt
and sorted by that key, distributed prefix sums of their sizes are taken, and the source is cut at
its budget. Budgets above the source's size repeat whole epochs first.

Budgets: the mix holds as many words as all documents. Sources, ordered by code point with null
last, weigh 5, 2, 1, 5, 2, 1 ... A target stops at 3 times its source's size and the excess goes
to the others by weight until none is above: target = min(3 * size, level * weight) for the one
level at which the targets sum to the total.

Cases: a null or blank text has size 0 and is never taken. A source with no words gets target 0.
A null doc_id hashes as the empty string. Equal keys are ordered by doc_id, size, then text hash, so
repeated rows differ only in which of them the cut meets. An empty table gives an empty result.
Columns of documents keep their values, whatever their names. Budgets are set in windows over the
sources, one narrow row each, in one task: sources may be thousands or a million, not as many as
documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.ranks import group_ranks, running_total
from lettermill.llm.common import WORD, cut, packed, steps_to_one_table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def _source(source_col: str) -> Column:
    """The source with a mark before it that puts null last."""
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _source(source_col).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        _key(id_col).alias("key"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )


def budgets(sized: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(src, source_size, target, budget) from (src, size). One row a source: windows here see sources only."""
    sizes = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("src")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
    s = s.withColumn("fills_at", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fills_at", "src")
    s = (
        s.withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # sources fill in the order of fills_at; the level is that of the first one that does not fill
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "src", "level"))).over(all_rows)["level"]
    s = s.withColumn("level", level).withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    return s.select("src", "source_size", F.coalesce("target", F.lit(0.0)).alias("target")).withColumn("budget", F.round("target").cast("long"))


def _plan(docs: DataFrame, weights: Sequence[float], id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = cut(_sized(docs, id_col, text_col, source_col))
    placed = running_total(sized, "src", "key", ["doc_id", "size", "text_hash"], "size", "before")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    # read back as a table, the budgets have a known size and are broadcast if that is small
    return placed.join(cut(budgets(sized, weights)), "src").withColumn("taken", (epochs * F.col("size") + part).cast("long"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, src, size, key, source_size, target, taken): the words the mix takes of each row."""
    return _plan(docs, weights, id_col, text_col, source_col).select("doc_id", "src", "size", "key", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of docs once for every epoch that takes it; all columns stay.

    The cut falls inside one document a source, which is given whole. Each source's cut, a table of
    one row a source, is what the rows are compared with in the plan's whole order, so no text is
    shuffled but those that equal the cut in it; of these, as many as the plan takes appear.
    """
    with steps_to_one_table(docs.sparkSession):
        planned = _plan(docs, weights, id_col, text_col, source_col).where("size > 0")
        epochs = F.expr("cast(round(target) AS bigint) div source_size")
        # documents up to the last one that is taken beyond the whole epochs appear once more
        extra = F.when(F.col("taken") > epochs * F.col("size"), F.struct("key", F.struct("doc_id", "size", "text_hash").alias("ties")))
        cuts = planned.withColumn("extra", extra).groupBy(F.col("src").alias("of"), "extra").agg(F.max(epochs).alias("epochs"), F.count(F.lit(1)).alias("n"))
        cuts = cuts.groupBy("of").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("extra").isNotNull(), F.struct("extra", "n"))).alias("m"))
        # read back as a table, the cuts have a known size and are broadcast if that is small, so texts stay in place
        cuts = cut(cuts.select("of", "epochs", F.col("m.extra.key").alias("last"), F.col("m.extra.ties").alias("last_ties"), F.col("m.n").alias("n_last")))
    keyed = packed(docs.where(F.col(text_col).rlike(WORD)), src=_source(source_col), key=_key(id_col))
    keyed = keyed.join(cuts, F.col("src") == F.col("of"))
    key, last, text = F.col("key"), F.col("last"), F.col(f"row.`{text_col}`")
    # sizes are counted for equal keys only
    tied = F.struct(F.col(f"row.`{id_col}`").alias("doc_id"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    side = F.when(last.isNull() | (key > last), 1).when(key < last, -1).when(tied < F.col("last_ties"), -1).when(tied > F.col("last_ties"), 1).otherwise(0)
    keyed = keyed.withColumn("side", side)
    clear = keyed.where("side <> 0").select("row", (F.col("epochs") + F.when(F.col("side") < 0, 1).otherwise(0)).alias("times"))
    at_cut = group_ranks(keyed.where("side = 0"), "src", "last", [], "rank")
    at_cut = at_cut.select("row", (F.col("epochs") + F.when(F.col("rank") < F.col("n_last"), 1).otherwise(0)).alias("times"))
    chosen = clear.union(at_cut).where("times > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("row.*")
