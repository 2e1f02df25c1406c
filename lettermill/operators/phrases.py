"""Many phrases in many texts at once: phrases and texts meet by their words, not phrase by phrase.

Words are runs of letters, digits and underscores, in lower case; what stands between them plays no
part. A text is cut into its runs of as many words as phrases have, and these are joined with the
table of phrases, so the cost of a text depends on the number of different lengths and not on the
number of phrases. Where the table is small, it is broadcast and texts stay where they are; where it
is large, runs and phrases are shuffled, and a common run is split like any other skewed key.

Cases: null and blank texts and phrases have no words and match nothing. Phrases that agree in their
words are one. A row is told by its id; rows that share one are counted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Different lengths of phrases; each is one more reading of a text's words.
MAX_LENGTHS = 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def phrase_counts(docs: DataFrame, phrases: DataFrame, id_col: str = "id", text_col: str = "text", phrase_col: str = "phrase") -> DataFrame:
    """(id, phrase, n): how often each phrase, as its words with one blank between them, occurs in a text."""
    table = phrases.select(words(F.col(phrase_col)).alias("w")).where("size(w) > 0").select(F.array_join("w", " ").alias("phrase"), F.size("w").alias("length")).distinct()
    lengths = sorted(r.length for r in table.select("length").distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"phrases of more than {MAX_LENGTHS} different lengths")

    def runs(found: Column, length: int) -> Column:
        last = F.size(found) - length
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(found, i + 1, length), " "))

    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    each = texts.select("id", F.explode(F.flatten(F.array(*[runs(F.col("w"), n) for n in lengths])) if lengths else F.array().cast("array<string>")).alias("phrase"))
    return each.join(table.select("phrase"), "phrase").groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("n"))
