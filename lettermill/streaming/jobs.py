"""Streaming forms of the row-wise jobs: resumable collection, redaction, scoring and progress counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from lettermill.operators.datasets import unseen
from lettermill.operators.redaction import audit, pseudonymize
from lettermill.sources import committed
from lettermill.sources.sinks import save_redacted


def read_landing(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", **options: str) -> DataFrame:
    """Files that land under path, each once; partitioned landing folders are pruned by the reader."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def first_seen(stream: DataFrame, key: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key has not been seen within the delay; the watermark bounds the state.

    A time without zone is read as an instant, since watermarks take no others.
    """
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def collect_new(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append all that is available now and stop; a later run goes on where this one ended."""
    return stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_unseen(stream: DataFrame, key: str, path: str, checkpoint: str, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Append the rows whose key path does not hold yet, once a key, and stop; nothing is ever forgotten.

    What path holds is the ledger, so a run after any pause, or one whose checkpoint was lost, collects
    no key twice. Of rows with one key in a batch the first by `order` stays; rows without a key are
    kept once a batch. The ledger's keys that the batch has are found first, by a scan of one column
    that the batch's keys filter, so no more of the ledger than these is shuffled. Read the result
    with `collected`.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'run'}-{number:09d}"
        if committed.is_committed(spark, f"{path}/log", name):
            return
        rows = batch
        if order:
            first = F.min_by(F.struct(*[F.col(c) for c in batch.columns]), F.struct(*[F.col(c) for c in order]))
            rows = batch.groupBy(F.col(key).alias("_key")).agg(first.alias("row")).select("row.*")
        rows = rows.persist()
        known = collected(spark, path, batch.schema).select(key).join(rows.select(key), key, "left_semi")
        committed.commit({f"{path}/rows": unseen(rows, known, key)}, f"{path}/log", name)
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that collect_unseen has committed to path."""
    return committed.read(spark, f"{path}/log", f"{path}/rows", schema)


def redact_stream(stream: DataFrame, path: str, audit_path: str, checkpoint: str, text_col: str = "text", id_cols: tuple[str, ...] = ("id",)) -> StreamingQuery:
    """Redacted rows to one folder, original values to another, by one commit a batch.

    A replayed batch is committed once, and readers (sinks.read_redacted) see both parts of it or none.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId') or 'run'}-{number:09d}"
        done = pseudonymize(batch, text_col).persist()
        save_redacted(done.drop("spans"), audit(done, id_cols), path, audit_path, name)
        done.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, classifier, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Scores and labels for each incoming text with a fitted classifier."""
    from lettermill.functions.labels import classify, sigmoid

    return classify(classifier.score(stream).withColumn("probs", sigmoid(F.col("logits"))), text_col, "probs", threshold)


def observed(df: DataFrame, name: str, **steps) -> tuple[DataFrame, Observation]:
    """Counts of the rows that pass, and of those that meet each named condition, gathered while df is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in steps.items()]), seen
