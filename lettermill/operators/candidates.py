"""Quote candidates for labelling: extraction, filter, flat records, score bands and suggestion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions import quotes

MIN_SCORE, MIN_CHARS, MAX_CHARS = 0.4, 80, 2000
NO_SUGGESTION = "__geen_suggestie__"


def candidates(rulings: DataFrame, min_score: float = MIN_SCORE, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rulings to flat candidates, one scan of each text for quotes; only what precedes a quote is read again."""
    # outer, since the inner form would first extract everything to see whether there is anything
    found = rulings.select("ecli", "content_url", "instance", "decision_date", "subject", F.explode_outer(quotes.extract(F.col("full_text"))).alias("c"))
    kept = found.where((F.col("c.quality_score") >= min_score) & F.length("c.quote").between(min_chars, max_chars))
    number = F.concat_ws("|", "ecli", F.col("c.quote_start_in_text").cast("string"))
    return kept.select(
        F.concat(F.lit("rcs-"), F.substring(F.md5(number), 1, 10)).alias("id"),
        "ecli",
        F.col("content_url").alias("source_url"),
        "instance",
        "decision_date",
        "subject",
        "c.quote",
        "c.preceding_context",
        "c.quote_start_in_text",
        "c.suggested_labels",
        "c.suggestion_reason",
        F.round("c.quality_score", 3).alias("quality_score"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(None).cast("string").alias("label_confidence"),
        F.lit("").alias("labeller_notes"),
    )


def to_examples(labelled: DataFrame) -> DataFrame:
    """Candidates that were given labels, in the shape of labelled examples."""
    return labelled.where(F.size("labels") > 0).select(
        "id",
        F.col("quote").alias("text"),
        F.lit("rechtspraak").alias("source"),
        "source_url",
        "labels",
        F.col("label_confidence").alias("confidence"),
        F.nullif("labeller_notes", F.lit("")).alias("notes"),
        F.array().cast("array<string>").alias("borderline_flags"),
        F.lit("nl").alias("language"),
        F.lit(False).alias("pseudonymized"),
        F.current_timestamp().alias("created_at"),
    )


def for_review(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates by score, then id."""
    return found.orderBy(F.desc("quality_score"), "id").limit(k)


def score_bands(found: DataFrame) -> DataFrame:
    """(band, n) for 0.8+, 0.6-0.8 and 0.4-0.6."""
    s = F.col("quality_score")
    return found.groupBy(F.when(s >= 0.8, "0.8+").when(s >= 0.6, "0.6-0.8").otherwise("0.4-0.6").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def suggestion_counts(found: DataFrame) -> DataFrame:
    """(label, n) by count; candidates without a suggestion count under NO_SUGGESTION."""
    labels = F.when(F.size("suggested_labels") == 0, F.array(F.lit(NO_SUGGESTION))).otherwise(F.col("suggested_labels"))
    return found.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
