"""Pseudonymise a text column, audit what was replaced, and count it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import pii
from lettermill.functions.once import with_once
from lettermill.functions.spans import no_spans, public, resolve_overlaps

# Names of the kinds of personal data.
PATTERNS = ("BSN", "EMAIL", "IBAN", "POSTCODE", "TELEFOON")


def with_spans(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Add the resolved spans. Each finder runs once a row, however often later columns name the spans."""
    text, first = F.col(text_col), f"{out}_but_bsn"
    found = F.concat(pii.find_emails(text), pii.find_ibans(text), pii.find_phones(text), pii.find_postcodes(text))
    rows = with_once(df, **{first: F.when(text.isNull(), no_spans()).otherwise(found)})
    every = F.concat(first, pii.find_bsns(text, F.col(first)))
    return with_once(rows, **{out: F.when(text.isNull(), no_spans()).otherwise(resolve_overlaps(every))}).drop(first)


def pseudonymize(df: DataFrame, text_col: str = "text", flag_col: str = "pseudonymized", spans_col: str = "spans") -> DataFrame:
    """Replace personal data in text_col, set flag_col and keep the spans in spans_col.

    A null or empty text passes through and is not flagged. Works on streaming DataFrames.
    """
    text = F.col(text_col)
    judged = F.coalesce(text != "", F.lit(False))
    done = with_spans(df, text_col, spans_col)
    return done.withColumns(
        {
            text_col: F.when(judged, pii.redact(text, F.col(spans_col))).otherwise(text),
            flag_col: F.when(judged, True).otherwise(F.col(flag_col) if flag_col in df.columns else F.lit(False)),
        }
    )


def audit(redacted: DataFrame, id_cols: tuple[str, ...] = ("id",), spans_col: str = "spans") -> DataFrame:
    """(record_id, pattern, original, placeholder, start, end): one row a replacement.

    The record's id is the first of id_cols that is neither null nor empty. Keep this apart from
    the redacted rows.
    """
    record = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in id_cols])
    return redacted.select(record.alias("record_id"), F.explode(public(F.col(spans_col))).alias("s")).select("record_id", "s.*")


def stats(redacted: DataFrame, by: tuple[str, ...] = (), spans_col: str = "spans") -> DataFrame:
    """(records, redacted_records, redactions) over all rows or by the given columns."""
    n = F.size(spans_col)
    return redacted.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if(n > 0).alias("redacted_records"), F.sum(n).cast("long").alias("redactions"))


def pattern_counts(redacted: DataFrame, spans_col: str = "spans", patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(pattern, n) by pattern name, for patterns that occur. Counted in place: exploding the spans would find them twice."""

    def count(name: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(spans_col, lambda s: s["pattern"] == name))), F.lit(0)).cast("long")

    one = redacted.agg(*[count(name).alias(name) for name in patterns])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("pattern"), F.col(name).alias("n")) for name in patterns]))
    return one.select(rows.alias("r")).select("r.*").where("n > 0").orderBy("pattern")
