"""A weighted multi-label baseline: logistic heads on hashed TF-IDF, all trained by one optimizer.

Texts become rows of term buckets (crc32 of a word, modulo the number of features) with
tf x ln((n + 1) / (df + 1)) of unit length, and a constant. A head is a label at one setting of
penalty and positive weight; its loss is weighted binary cross-entropy, divided by the sum of the
weights, plus reg / 2 times the squared weights (the constant is free). Accelerated gradient descent
with the step that bounds the loss's curvature takes all heads of all settings through the data
together: an iteration is one pass, in which every task adds up the gradients of its blocks, and the
sums are added in levels of FAN, so neither the driver nor a task gets more than FAN of them.

The model is plain numbers (a weight table and the terms' idf), with no tie to the session or the
training run; scoring is a column expression without a join, also on streams. It stands in for a
fine-tuned encoder and makes no claim to equal it.

Cases: null texts count as empty, null labels as none, unknown labels are ignored. A label without
rows on both sides has no head and gets the logit -20. Empty tables give a model without heads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.labels import LABELS
from lettermill.operators.evaluation import averages, benchmark, best_epoch, best_thresholds, label_scores
from lettermill.sources.sinks import nest_metrics, save_report

POSITIVE_WEIGHT = 8.0
FEATURES = 1 << 14
NO_HEAD = -20.0
WORD = r"[\p{L}\p{N}_]+"
#: Rows of a block, and sums that one task or the driver adds up.
BLOCK_ROWS, FAN = 1024, 32
#: Terms of a part of the training table on average. Arrow passes up to 10,000 blocks at once, so what a Python worker holds is bounded by its part.
PART_TERMS = 1 << 21
#: In the weight table, the bucket of the constant.
CONSTANT = -1


def term_buckets(text: Column, features: int) -> Column:
    """The bucket of every word of a text, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % features).cast("int"))


def _rows(terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the rows' distinct terms, each row of unit length."""
    n, size = len(terms), len(idf)
    key, tf = np.unique(pc.list_parent_indices(terms).to_numpy().astype(np.int64) * size + terms.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    row, bucket = key // size, key % size
    value = tf * idf[bucket]
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    return row, bucket, np.divide(value, norm[row], out=np.zeros_like(value), where=norm[row] > 0)


def _dot(n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows times weights, whose last row is the constant's."""
    out = np.tile(weights[-1], (n, 1))
    for h in range(weights.shape[1]):
        out[:, h] += np.bincount(row, value * weights[bucket, h], minlength=n)
    return out


@dataclass
class Classifier:
    """weights: (features + 1) x heads, the constant last; heads: the labels that have one, in order of the columns."""

    idf: np.ndarray
    weights: np.ndarray
    heads: Sequence[str]
    labels: Sequence[str] = LABELS
    text_col: str = "text"
    history: list[tuple[str, int, float]] = field(default_factory=list)

    def logits(self, df: DataFrame) -> Column:
        """array<double> in the order of the labels, from df's text column. The numbers are broadcast; their size is fixed by features and labels."""
        shared = df.sparkSession.sparkContext.broadcast((self.idf, self.weights))
        at = [self.labels.index(x) for x in self.heads]
        width = len(self.labels)

        def score(terms: pa.Array) -> pa.Array:
            idf, weights = shared.value
            parts = [np.empty(0)]
            for start in range(0, len(terms), BLOCK_ROWS):
                block = terms.slice(start, BLOCK_ROWS)
                out = np.full((len(block), width), NO_HEAD)
                out[:, at] = _dot(len(block), *_rows(block, idf), weights)
                parts.append(out.ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1, dtype=np.int32) * width), pa.array(np.concatenate(parts)))

        return F.arrow_udf(score, "array<double>")(term_buckets(F.col(self.text_col), len(self.idf)))

    def score(self, df: DataFrame) -> DataFrame:
        """Add logits, in place of a column of that name."""
        return df.withColumn("logits", self.logits(df))


def weight_table(classifier: Classifier, spark: SparkSession) -> DataFrame:
    """(label, bucket, weight): the model as a table; the constant's bucket is CONSTANT, weights of zero are left out."""
    at, head = np.nonzero(classifier.weights)
    bucket = np.where(at == len(classifier.idf), CONSTANT, at)
    columns = {"label": pa.array([classifier.heads[h] for h in head], pa.string()), "bucket": pa.array(bucket, pa.int32()), "weight": pa.array(classifier.weights[at, head], pa.float64())}
    return spark.createDataFrame(pa.table(columns))


def _labelled(df: DataFrame, text_col: str, labels_col: str, labels: Sequence[str], features: int) -> DataFrame:
    has = F.coalesce(F.col(labels_col), F.array().cast("array<string>"))
    return df.select(term_buckets(F.col(text_col), features).alias("terms"), F.array(*[F.array_contains(has, x) for x in labels]).alias("y"))


def _parted(rows: DataFrame, n_terms: int) -> DataFrame:
    """The rows in parts of about PART_TERMS terms, as many more as the table is larger; a table that one core's part holds stays as it is."""
    n_parts = -(-n_terms // PART_TERMS)
    return rows if n_parts <= 1 else rows.repartition(max(n_parts, rows.sparkSession.sparkContext.defaultParallelism))


def _blocks(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(row, bucket, value, y) as packed arrays, BLOCK_ROWS rows each."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                terms, y = (c.slice(start, BLOCK_ROWS) for c in batch.columns)
                row, bucket, value = _rows(terms, shared.value)
                flags = y.flatten().to_numpy(zero_copy_only=False)
                packed = [row.astype(np.int32), bucket.astype(np.int32), value, flags.astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=["row", "bucket", "value", "y"])

    return rows.mapInArrow(pack, "row binary, bucket binary, value binary, y binary")


def _summed(parts: DataFrame, n_parts: int) -> np.ndarray:
    """The sum of one array a task, (at, total), added in levels of at most FAN arrays a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                array = np.frombuffer(x.as_py(), dtype=np.float64)
                total = array.copy() if total is None else total + array
                first = at if first is None else min(first, at)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "total"])

    while n_parts > FAN:
        n_parts = -(-n_parts // FAN)
        parts = parts.repartition(n_parts, (F.col("at") % n_parts)).mapInArrow(add, "at int, total binary")
    arrays = [np.frombuffer(bytes(r.total), dtype=np.float64) for r in parts.orderBy("at").collect()]
    return np.sum(arrays, axis=0)


def _gradient(blocks: DataFrame, n_parts: int, weights: np.ndarray, label_at: np.ndarray, positive: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of each head's weighted gradient and loss: one pass."""
    shared = blocks.sparkSession.sparkContext.broadcast((weights, label_at, positive))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, label_at, positive = shared.value
        total, loss, met = np.zeros_like(weights), np.zeros(weights.shape[1]), False
        for batch in batches:
            for packed in zip(*batch.columns, strict=True):
                row, bucket, value, y = (np.frombuffer(x.as_py(), dtype=t) for x, t in zip(packed, (np.int32, np.int32, np.float64, np.int8), strict=True))
                y = y.reshape(-1, n_labels)[:, label_at]
                z = _dot(len(y), row, bucket, value, weights)
                w = np.where(y == 1, positive, 1.0)
                loss += (w * np.logaddexp(0.0, np.where(y == 1, -z, z))).sum(axis=0)
                r = w * (1 / (1 + np.exp(-z)) - y)
                for h in range(weights.shape[1]):
                    total[:-1, h] += np.bincount(bucket, value * r[row, h], minlength=len(weights) - 1)
                total[-1] += r.sum(axis=0)
                met = True
        if met:
            sums = np.append(total.ravel(), loss)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["at", "total"])

    sums = _summed(blocks.mapInArrow(partial, "at int, total binary"), n_parts)
    shared.unpersist()
    return sums[: weights.size].reshape(weights.shape), sums[weights.size :]


def train_grid(df: DataFrame, settings: Sequence[dict], text_col: str = "text", labels_col: str = "labels", labels: Sequence[str] = LABELS, max_iter: int = 50, features: int = FEATURES) -> list[Classifier]:
    """One classifier for each setting (reg, positive_weight), all trained in the same passes over df."""
    settings = [{"reg": 0.01, "positive_weight": POSITIVE_WEIGHT} | s for s in settings]
    rows = _labelled(df, text_col, labels_col, labels, features).persist()
    blocks = None
    try:
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms").cast("long")).alias("terms"), *[F.count_if(F.get("y", F.lit(i))).alias(f"c{i}") for i in range(len(labels))]).first()
        n = counts["n"]
        heads = [i for i in range(len(labels)) if 0 < counts[f"c{i}"] < n]
        seen = rows.select(F.explode(F.array_distinct("terms")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
        idf = np.full(features, math.log(n + 1))
        for r in seen.collect():
            idf[r.bucket] = math.log((n + 1) / (r.df + 1))
        label_at = np.array(heads * len(settings), dtype=np.int64)
        reg, positive = (np.array([float(s[k]) for s in settings for _ in heads]) for k in ("reg", "positive_weight"))
        weights = np.zeros((features + 1, len(label_at)))
        losses: list[np.ndarray] = []
        if heads:
            sizes = np.array([n + (p - 1) * counts[f"c{i}"] for i, p in zip(label_at, positive, strict=True)])
            blocks = _blocks(_parted(rows, counts["terms"]), idf).persist()
            n_parts = blocks.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] + 1
            point, t = weights, 1.0
            for _ in range(max_iter):
                total, loss = _gradient(blocks, n_parts, point, label_at, positive, len(labels))
                gradient = total / sizes
                gradient[:-1] += reg * point[:-1]
                losses.append(loss / sizes + reg / 2 * (point[:-1] ** 2).sum(axis=0))
                # rows have length one beside the constant, so the curvature is a quarter of two at most, and the penalty
                new, t_next = point - gradient / (0.5 + reg), (1 + math.sqrt(1 + 4 * t * t)) / 2
                point, weights, t = new + (t - 1) / t_next * (new - weights), new, t_next
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.unpersist()
    out = []
    for s in range(len(settings)):
        own = slice(s * len(heads), (s + 1) * len(heads))
        history = [(labels[i], k, float(v)) for j, i in enumerate(heads) for k, v in enumerate(x[own][j] for x in losses)]
        out.append(Classifier(idf, weights[:, own], [labels[i] for i in heads], tuple(labels), text_col, history))
    return out


def train(df: DataFrame, text_col: str = "text", labels_col: str = "labels", labels: Sequence[str] = LABELS, reg: float = 0.01, max_iter: int = 50, positive_weight: float = POSITIVE_WEIGHT, features: int = FEATURES) -> Classifier:
    """Fit one head for each label that has rows on both sides, all in one pass an iteration."""
    return train_grid(df, [{"reg": reg, "positive_weight": positive_weight}], text_col, labels_col, labels, max_iter, features)[0]


def save(classifier: Classifier, spark: SparkSession, path: str) -> None:
    """Write the weight table, the terms' idf and one row of names below path."""
    weight_table(classifier, spark).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame(pa.table({"bucket": np.arange(len(classifier.idf), dtype=np.int32), "idf": classifier.idf})).write.mode("overwrite").parquet(f"{path}/idf")
    names = [(list(classifier.heads), list(classifier.labels), classifier.text_col)]
    spark.createDataFrame(names, "heads array<string>, labels array<string>, text_col string").write.mode("overwrite").parquet(f"{path}/names")


def load(spark: SparkSession, path: str) -> Classifier:
    """Read a saved classifier: tables of a size that features and labels fix."""
    names = spark.read.parquet(f"{path}/names").first()
    idf = spark.read.parquet(f"{path}/idf").orderBy("bucket").toArrow()["idf"].to_numpy()
    table = spark.read.parquet(f"{path}/weights").toArrow()
    weights = np.zeros((len(idf) + 1, len(names.heads)))
    bucket = table["bucket"].to_numpy()
    heads = np.array([names.heads.index(x) for x in table["label"].to_pylist()], dtype=np.int64)
    weights[np.where(bucket == CONSTANT, len(idf), bucket), heads] = table["weight"].to_numpy()
    return Classifier(idf, weights, names.heads, tuple(names.labels), names.text_col)


def loss_history(classifier: Classifier) -> list[tuple[str, int, float]]:
    """(label, iteration, objective) of the training run."""
    return list(classifier.history)


def choose(train_rows: DataFrame, val_rows: DataFrame, grid: Sequence[dict], max_iter: int = 50, features: int = FEATURES, **options) -> tuple[Classifier, DataFrame]:
    """Train all settings together and keep the best on val_rows (by argmax or threshold macro-F1; the first among equals).

    val_rows is scored once for all settings.
    """
    fitted = train_grid(train_rows, grid, max_iter=max_iter, features=features, **options)
    each = F.posexplode(F.array(*[c.logits(val_rows) for c in fitted])).alias("epoch", "logits")
    scored = val_rows.select("id", "labels", each)
    means = averages(label_scores(scored, keys=("epoch",)), keys=("epoch",)).where("family in ('argmax', 'threshold')").collect()
    by = {(r.epoch, r.family): r.macro_f1 for r in means}
    history = [(i, by.get((i, "argmax"), 0.0), by.get((i, "threshold"), 0.0)) for i in range(len(fitted))]
    table = train_rows.sparkSession.createDataFrame(history, "epoch int, argmax_macro_f1 double, macro_f1 double")
    return fitted[best_epoch(table).first()["best_epoch"]], table


def tune_and_report(classifier: Classifier, val_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Thresholds from val_rows, metrics on test_rows (with an eval_set column) in long form."""
    tuned = best_thresholds(classifier.score(val_rows), keys=()).select("label_id", "threshold")
    return benchmark(classifier.score(test_rows), tuned)


def save_run(classifier: Classifier, runs: DataFrame, val_rows: DataFrame, test_rows: DataFrame, path: str) -> None:
    """All that a training run leaves, below path: model, losses, the settings' scores on val_rows, and the report.

    The report has the metrics on test_rows and, by label, the thresholds that val_rows give.
    """
    spark = val_rows.sparkSession
    save(classifier, spark, f"{path}/model")
    losses = spark.createDataFrame(loss_history(classifier), "label string, iteration int, objective double")
    losses.write.mode("overwrite").parquet(f"{path}/losses")
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    tuned = best_thresholds(classifier.score(val_rows), keys=()).select("label_id", "label", "threshold")
    metrics = benchmark(classifier.score(test_rows), tuned.select("label_id", "threshold"))
    sets = metrics.select("eval_set").distinct()
    # the thresholds, nine at most, travel as a constant
    each = F.explode(F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.threshold).alias("value")) for r in tuned.collect()])).alias("t")
    chosen = sets.select("eval_set", each).select("eval_set", F.lit("tuned").alias("family"), "t.label", F.lit("threshold").alias("metric"), "t.value")
    save_report(nest_metrics(metrics.unionByName(chosen)), f"{path}/report")
