"""Evaluation of scored examples (id, eval_set, labels, logits): metrics, thresholds, confusion, comparison.

Results are long tables; counts are gathered in one pass over the nine cells of a row and everything
after that sees a few rows for each evaluation set and label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.functions.labels import LABELS, argmax, encode, label_of, sigmoid
from lettermill.functions.storage import cut

# Thresholds tried, the default threshold, and the change that counts as one.
GRID = tuple(0.05 + i * 0.02 for i in range(45))
DEFAULT = 0.5
CHANGE = 0.001
KEYS = ("eval_set",)


def cells(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, id, label_id, p, y, is_top): one row for each example and label."""
    probs = scored.select(*keys, "id", sigmoid(F.col("logits")).alias("p"), encode(F.col("labels")).alias("y"))
    each = F.posexplode(F.arrays_zip("p", "y")).alias("label_id", "c")
    return probs.select(*keys, "id", argmax(F.col("p")).alias("top"), each).select(*keys, "id", "label_id", "c.p", "c.y", (F.col("label_id") == F.col("top")).alias("is_top"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _scores(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts (*keys, family, label_id, tp, n_pred, n_true) with precision, recall and F1, 0 where undefined."""
    return counts.select(
        *keys, "family", "label_id", label_of(F.col("label_id")).alias("label"), "tp", "n_pred", "n_true",
        _ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_true")).alias("recall"),
        _ratio(F.col("tp") * 2.0, F.col("n_pred") + F.col("n_true")).alias("f1"),
    )


def profile(scored: DataFrame, grid: Sequence[float] = GRID, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts from which every metric follows: (*keys, label_id, reached, n, pos, top, top_pos, p_true, p_false).

    `reached` is how many of the levels (grid and default, ascending) a cell's probability reaches,
    so an evaluation set of any size gives a few dozen rows a label, in one pass and with partial sums.
    """
    levels = F.array(*[F.lit(t) for t in _levels(grid)])
    is_true = F.col("y") == 1
    return cells(scored, keys).groupBy(*keys, "label_id", F.size(F.filter(levels, lambda t: F.col("p") >= t)).alias("reached")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_true).alias("pos"),
        F.count_if("is_top").alias("top"),
        F.count_if(F.col("is_top") & is_true).alias("top_pos"),
        F.sum(F.when(is_true, F.col("p")).otherwise(0.0)).alias("p_true"),
        F.sum(F.when(is_true, 0.0).otherwise(F.col("p"))).alias("p_false"),
    )


def _levels(grid: Sequence[float]) -> list[float]:
    return sorted({float(t) for t in grid} | {DEFAULT})


def _family(prof: DataFrame, family: str, n_pred: Column, tp: Column, keys: Sequence[str]) -> DataFrame:
    counts = prof.groupBy(*keys, "label_id").agg(F.sum("pos").alias("n_true"), F.sum(n_pred).alias("n_pred"), F.sum(tp).alias("tp"))
    return _scores(counts.withColumn("family", F.lit(family)), keys)


def _at_level(prof: DataFrame, family: str, level: Column, keys: Sequence[str]) -> DataFrame:
    """Scores when cells that reach more than `level` levels are predicted."""
    over = lambda c: F.when(F.col("reached") > level, F.col(c)).otherwise(0)
    return _family(prof, family, over("n"), over("pos"), keys)


def _default_scores(prof: DataFrame, grid: Sequence[float], keys: Sequence[str]) -> DataFrame:
    at = F.lit(_levels(grid).index(DEFAULT))
    return _at_level(prof, "threshold", at, keys).union(_family(prof, "argmax", F.col("top"), F.col("top_pos"), keys))


def label_scores(scored: DataFrame, thresholds: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-label scores by family: threshold (0.5), argmax and, with (label_id, threshold), tuned."""
    c = cells(scored, keys)
    tests = {"threshold": F.col("p") >= DEFAULT, "argmax": F.col("is_top")}
    if thresholds is not None:
        on = [k for k in (*keys, "label_id") if k in thresholds.columns]
        # read back as a table, nine rows for each key, the thresholds have a known size and are broadcast if that is small
        c = c.join(cut(thresholds.select(*on, "threshold")), on)
        tests["tuned"] = F.col("p") >= F.col("threshold")
    sums = [F.count_if(F.col("y") == 1).alias("n_true")]
    for name, test in tests.items():
        sums += [F.count_if(test).alias(f"{name}_pred"), F.count_if(test & (F.col("y") == 1)).alias(f"{name}_tp")]
    wide = c.groupBy(*keys, "label_id").agg(*sums)
    families = F.array(*[F.struct(F.lit(n).alias("family"), F.col(f"{n}_tp").alias("tp"), F.col(f"{n}_pred").alias("n_pred")) for n in tests])
    return _scores(wide.select(*keys, "label_id", "n_true", F.explode(families).alias("f")).select(*keys, "label_id", "n_true", "f.*"), keys)


def segment_scores(scored: DataFrame, segments: Sequence[Sequence[str]], thresholds: Sequence[float] = (DEFAULT,), keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, *segment columns, level, threshold, label_id, label, tp, n_pred, n_true, precision, recall, f1) for many groupings in one pass.

    `segments` lists groupings, each a set of columns of scored; () is the whole set. Cells are counted
    once, by grouping sets, and `level` names the columns that a row is grouped by, so a null value of
    a segment is told from a row over all its values.
    """
    columns = list(dict.fromkeys(c for s in segments for c in s))
    kept = scored.withColumn("_seg", F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(0).alias("none")))
    each = cells(kept, (*keys, "_seg")).select(*keys, *[F.col(f"_seg.`{c}`").alias(c) for c in columns], "label_id", "p", "y")
    sums = [F.count_if(F.col("y") == 1).alias("n_true")]
    for i, t in enumerate(thresholds):
        sums += [F.count_if(F.col("p") >= t).alias(f"_pred{i}"), F.count_if((F.col("p") >= t) & (F.col("y") == 1)).alias(f"_tp{i}")]
    base = [*keys, "label_id"]
    grouped = each.groupingSets([[F.col(c) for c in (*base, *s)] for s in segments], *[F.col(c) for c in (*base, *columns)])
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]) if columns else F.lit("")
    wide = grouped.agg(level.alias("level"), *sums)
    tried = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_pred{i}").alias("n_pred")) for i, t in enumerate(thresholds)]))
    long = wide.select(*base, *columns, "level", "n_true", tried.alias("f")).select(*base, *columns, "level", "n_true", "f.*")
    return _scores(long.withColumn("family", F.lit("threshold")), (*keys, *columns, "level", "threshold")).drop("family")


def averages(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, family, macro_f1, micro_f1): macro over all nine labels, with 0 for those without cases."""
    micro = _ratio(F.sum("tp") * 2.0, F.sum("n_pred") + F.sum("n_true"))
    return scores.groupBy(*keys, "family").agg(F.avg("f1").alias("macro_f1"), micro.alias("micro_f1"))


def probability_gap(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean probability over true cells, over false cells (0 without any), and the difference."""
    return _gap(profile(scored, (), keys), keys)


def _gap(prof: DataFrame, keys: Sequence[str]) -> DataFrame:
    n_true, n_false = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    means = prof.groupBy(*keys).agg(_ratio(F.sum("p_true"), n_true).alias("mean_prob_true_class"), _ratio(F.sum("p_false"), n_false).alias("mean_prob_false_class"))
    return means.withColumn("prob_gap", F.col("mean_prob_true_class") - F.col("mean_prob_false_class"))


def best_thresholds(scored: DataFrame, grid: Sequence[float] = GRID, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, label_id, label, threshold, f1): the grid's lowest threshold with the best F1.

    A label without positives keeps the default (F1 null).
    """
    return _best(profile(scored, grid, keys), grid, keys).drop("level")


def _best(prof: DataFrame, grid: Sequence[float], keys: Sequence[str]) -> DataFrame:
    levels = _levels(grid)
    hist = prof.groupBy(*keys, "label_id").agg(F.collect_list(F.struct("reached", "n", "pos")).alias("h"), F.sum("pos").alias("n_true"))

    def f1_at(i: Column) -> Column:
        over = F.filter("h", lambda x: x["reached"] > i)
        total = lambda f: F.aggregate(over, F.lit(0).cast("long"), lambda a, x: a + x[f])
        return F.struct((total("pos") * 2.0 / (total("n") + F.col("n_true"))).alias("f1"), (-i).alias("neg"))

    tried = F.array(*[F.lit(i) for i, t in enumerate(levels) if t in set(map(float, grid))])
    best = hist.withColumn("best", F.when(F.col("n_true") > 0, F.array_max(F.transform(tried, f1_at))))
    level = F.coalesce(-F.col("best.neg"), F.lit(levels.index(DEFAULT)))
    threshold = F.get(F.array(*[F.lit(t) for t in levels]), level)
    return best.select(*keys, "label_id", label_of(F.col("label_id")).alias("label"), threshold.alias("threshold"), F.col("best.f1").alias("f1"), level.alias("level"))


def confusion(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, true_label, pred_label, n) by argmax, zero cells included. A row without labels counts as the first class."""
    seen = scored.select(*keys, argmax(encode(F.col("labels"))).alias("t"), argmax(sigmoid(F.col("logits"))).alias("p")).groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("n"))
    ids = F.sequence(F.lit(0), F.lit(len(LABELS) - 1))
    every = seen.select(*keys).distinct().withColumn("t", F.explode(ids)).withColumn("p", F.explode(ids))
    return every.join(seen, [*keys, "t", "p"], "left").select(*keys, label_of(F.col("t")).alias("true_label"), label_of(F.col("p")).alias("pred_label"), F.coalesce("n", F.lit(0)).alias("n"))


def confusion_table(long: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return long.groupBy(*keys, "true_label").pivot("pred_label", list(LABELS)).sum("n")


def benchmark(scored: DataFrame, tuned: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, family, label, metric, value): all metrics of each evaluation set in long form.

    Families: threshold and argmax; tuned with thresholds from elsewhere (label_id, threshold);
    self_tuned with those of the set itself, which flatter and are only indicative. One pass over
    the examples writes the profile, and one more is made where thresholds come from elsewhere.
    """

    def long(rows: DataFrame, family: Column, label: Column, names: Sequence[str]) -> DataFrame:
        each = [F.struct(label.alias("label"), F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]
        return rows.select(*keys, family.alias("family"), F.explode(F.array(*each)).alias("m")).select(*keys, "family", "m.*")

    prof = cut(profile(scored, GRID, keys))
    own = prof.join(_best(prof, GRID, keys).select(*keys, "label_id", "level"), [*keys, "label_id"])
    scores = _default_scores(prof, GRID, keys).union(_at_level(own, "self_tuned", F.col("level"), keys))
    if tuned is not None:
        scores = scores.union(label_scores(scored, tuned, keys).where("family = 'tuned'").select(scores.columns))
    none = F.lit(None).cast("string")
    return (
        long(scores, F.col("family"), F.col("label"), ("precision", "recall", "f1"))
        .union(long(averages(scores, keys), F.col("family"), none, ("macro_f1", "micro_f1")))
        .union(long(_gap(prof, keys), F.lit("probability"), none, ("mean_prob_true_class", "mean_prob_false_class", "prob_gap")))
    )


def best_epoch(history: DataFrame, by: Sequence[str] = (), epoch_col: str = "epoch", scores: Sequence[str] = ("argmax_macro_f1", "macro_f1")) -> DataFrame:
    """The epoch with the largest of its scores, the earliest among equals, and that score."""
    score = F.greatest(*scores)
    pick = F.max(F.struct(score.alias("score"), (-F.col(epoch_col)).alias("neg")))
    return history.groupBy(*by).agg(pick.alias("b")).select(*by, (-F.col("b.neg")).alias("best_epoch"), F.col("b.score").alias("best_score"))


def loss_by_epoch(steps: DataFrame, by: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mean training loss of each epoch from step losses."""
    return steps.groupBy(*by).agg(F.avg("loss").alias("train_loss"))


def attach_gold(predictions: DataFrame, gold: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores with the labels of the same id; rows that lack either are left out."""
    return predictions.join(gold.select(id_col, "labels"), id_col)


def without_run_columns(metrics: DataFrame) -> DataFrame:
    return metrics.drop("epoch", "train_loss")


def compare(metrics: DataFrame, by: Sequence[str] = ("eval_set",)) -> DataFrame:
    """Metrics (model, pos, *by, value) to (*by, first_model, last_model, first, last, delta, arrow).

    First and last are the models with a value, by pos; with fewer than two there is no delta.
    """
    w = Window.partitionBy(*by).orderBy("pos", "model").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    present = metrics.where(F.col("value").isNotNull())
    ends = present.select(*by, F.first("model").over(w).alias("first_model"), F.last("model").over(w).alias("last_model"), F.first("value").over(w).alias("first"), F.last("value").over(w).alias("last"), F.count(F.lit(1)).over(w).alias("n_models")).distinct()
    delta = F.when(F.col("n_models") >= 2, F.col("last") - F.col("first"))
    return ends.withColumn("delta", delta).withColumn("arrow", F.when(delta > CHANGE, "↑").when(delta < -CHANGE, "↓").when(delta.isNotNull(), "·"))


def mean_over_sets(metrics: DataFrame) -> DataFrame:
    """(model, pos, value): mean over the sets that have a value."""
    return metrics.where(F.col("value").isNotNull()).groupBy("model", "pos").agg(F.avg("value").alias("value"))


def side_by_side(metrics: DataFrame, models: Sequence[str], by: Sequence[str] = ("eval_set",)) -> DataFrame:
    """One row for each key and one column a model; cells without a value stay null."""
    return metrics.groupBy(*by).pivot("model", list(models)).agg(F.first("value"))


def grid_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(GRID)], "i int, threshold double")
