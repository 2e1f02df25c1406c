"""The closed label set, multi-hot vectors, and scores to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels in class order, and the enumerations of labelled examples.
LABELS = ("aanvraag", "bezwaar", "beroep", "klacht", "melding", "zienswijze", "woo_verzoek", "informatieverzoek_3_11", "vraag_overig")
SOURCES = ("rechtspraak", "raadsinformatie", "woo", "ombudsman", "synthetic", "gold")
CONFIDENCES = ("hoog", "middel", "laag")


def names() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def label_table(spark: SparkSession) -> DataFrame:
    """(label_id, label): nine rows."""
    return spark.createDataFrame(list(enumerate(LABELS)), "label_id int, label string")


def label_of(label_id: Column) -> Column:
    return F.get(names(), label_id)


def id_of(label: Column) -> Column:
    """Class index; null for an unknown label."""
    return F.nullif(F.array_position(names(), label), F.lit(0)).cast("int") - 1


def encode(labels: Column) -> Column:
    """Multi-hot array<double>; unknown labels count for nothing, null as no labels."""
    return F.transform(names(), lambda n: F.when(F.array_contains(labels, n), 1.0).otherwise(0.0))


def decode(probs: Column, threshold: float = 0.5) -> Column:
    """Labels with a probability of at least the threshold, in class order."""
    return F.filter(names(), lambda n, i: F.coalesce(F.get(probs, i) >= threshold, F.lit(False)))


def decode_per_class(probs: Column, thresholds: Column) -> Column:
    return F.filter(names(), lambda n, i: F.coalesce(F.get(probs, i) >= F.get(thresholds, i), F.lit(False)))


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def argmax(values: Column) -> Column:
    """Index of the largest value, the first among equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ranked(probs: Column, threshold: float = 0.5) -> Column:
    """array<struct<score, label>> of the labels above the threshold by score desc."""
    both = F.zip_with(probs, names(), lambda p, n: F.struct(p.alias("score"), n.alias("label")))
    return F.sort_array(F.filter(both, lambda x: x["score"] >= threshold), asc=False)


def classify(df: DataFrame, text_col: str, probs_col: str, threshold: float = 0.5) -> DataFrame:
    """Add top_label, top_score, above (ranked) and abstains; a blank text has none of them."""
    blank = F.coalesce(F.trim(F.col(text_col)) == "", F.lit(True))
    p = F.col(probs_col)
    top = argmax(p)
    return df.select(
        "*",
        F.when(~blank, label_of(top)).alias("top_label"),
        F.when(~blank, F.get(p, top)).alias("top_score"),
        F.when(blank, F.array().cast("array<struct<score:double,label:string>>")).otherwise(ranked(p, threshold)).alias("above"),
        F.when(blank, True).otherwise(F.size(decode(p, threshold)) == 0).alias("abstains"),
    )
