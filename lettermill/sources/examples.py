"""Labelled examples as JSON lines: a strict scan with rejects, and the projection for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.labels import CONFIDENCES, LABELS, SOURCES, encode
from lettermill.functions.text import strip

EXAMPLE = (
    "id string, text string, source string, source_url string, labels array<string>, confidence string, notes string, "
    "borderline_flags array<string>, language string, pseudonymized boolean, created_at timestamp"
)


def _kind(v: Column, field: str) -> Column:
    """Type of a field; null if it is absent."""
    return F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))


def _valid(v: Column) -> Column:
    get = lambda field, kind: F.try_variant_get(v, f"$.{field}", kind)
    ok = F.lit(True)
    for field in ("id", "text", "source"):
        ok = ok & F.coalesce(_kind(v, field) == "STRING", F.lit(False))
    ok = ok & get("source", "string").isin(*SOURCES)
    for field in ("source_url", "confidence", "notes"):
        ok = ok & F.coalesce(_kind(v, field), F.lit("VOID")).isin("STRING", "VOID")
    confidence = get("confidence", "string")
    ok = ok & (confidence.isNull() | confidence.isin(*CONFIDENCES))
    for field in ("labels", "borderline_flags"):
        ok = ok & F.coalesce(_kind(v, field), F.lit("ARRAY<VOID>")).isin("ARRAY<STRING>", "ARRAY<VOID>")
    known = F.array(*[F.lit(x) for x in LABELS])
    ok = ok & (F.size(F.array_except(F.coalesce(get("labels", "array<string>"), F.array().cast("array<string>")), known)) == 0)
    ok = ok & F.coalesce(_kind(v, "language"), F.lit("STRING")).isin("STRING")
    ok = ok & F.coalesce(_kind(v, "pseudonymized"), F.lit("BOOLEAN")).isin("BOOLEAN")
    created = get("created_at", "string")
    ok = ok & (_kind(v, "created_at").isNull() | created.try_cast("timestamp").isNotNull())
    return F.coalesce(ok, F.lit(False))


def split_lines(lines: DataFrame, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(examples, rejects) of JSON lines. Blank lines vanish; a record that breaks a rule is rejected whole."""
    rows = lines.where(strip(F.col(line_col)) != "").withColumn("_v", F.try_parse_json(F.col(line_col)))
    rows = rows.withColumn("_ok", F.coalesce(_kind(F.col("_v"), "id").isNotNull() & _valid(F.col("_v")), F.lit(False)))
    parsed = F.from_json(F.col(line_col), EXAMPLE)
    kept = rows.where("_ok").select(parsed.alias("e"), *[c for c in lines.columns if c != line_col])
    empty = F.array().cast("array<string>")
    examples = kept.select("e.*", *[c for c in kept.columns if c != "e"])
    examples = examples.withColumns(
        {
            "labels": F.coalesce("labels", empty),
            "borderline_flags": F.coalesce("borderline_flags", empty),
            "language": F.coalesce("language", F.lit("nl")),
            "pseudonymized": F.coalesce("pseudonymized", F.lit(False)),
            "created_at": F.coalesce("created_at", F.current_timestamp()),
        }
    )
    return examples, rows.where("not _ok").select(lines.columns)


def read_examples(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(examples, rejects) of all files, each row with its file_path."""
    return split_lines(spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file_path")))


def training_rows(examples: DataFrame) -> DataFrame:
    """(text, labels as a multi-hot vector, id, source)."""
    return examples.select("text", encode(F.col("labels")).alias("labels"), "id", "source")


def from_generation(generated: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Generated letters (label or labels, style, cleaned text) as labelled examples.

    pseudonymized stays false until the text has been redacted. Ids are digests of text and style.
    """
    multi = F.size("labels") > 1
    notes = F.concat(F.when(multi, "multilabel; ").otherwise(""), F.lit("style="), F.col("style"), F.lit(f"; model={model}"))
    return generated.select(
        F.md5(F.concat_ws("|", F.col(text_col), "style", F.array_join("labels", ","))).alias("id"),
        F.col(text_col).alias("text"),
        F.lit("synthetic").alias("source"),
        F.lit(None).cast("string").alias("source_url"),
        "labels",
        F.lit(None).cast("string").alias("confidence"),
        notes.alias("notes"),
        F.array().cast("array<string>").alias("borderline_flags"),
        F.lit("nl").alias("language"),
        F.lit(False).alias("pseudonymized"),
        F.current_timestamp().alias("created_at"),
    )
