"""Fill-in-middle: texts cut in three at unit borders and put in the order that a model is trained on.

Units tile the text (lines by default). One fullmatch of (unit)* with the regex library keeps every
repetition of its group, so the ends of the first group are all unit borders: their number is n, and
the two that the row's hash picks are the cuts. The hash is the sha256 of `seed:id`; its first two
groups of 8 digits pick the cuts, the third decides whether a row is transformed, the fourth the form.
`restore` rebuilds the text from an output and its form.

Cases: a null text counts as empty; empty texts, texts that hold a sentinel and texts that units do
not tile stay as they are (form `plain`). A null id is hashed as the empty word, so rows without an id
are cut at the same fractions. Repeated rows give repeated rows, an empty table an empty result. Texts
are matched whole, whatever their length: a text's borders are one list of integers in its task.
Only id and text are read; further columns pass through under their names, within `row`.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lettermill.functions.once import with_once
from lettermill.llm.common import packed

#: Units by name. What is within a unit is never split.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "character": r"(?s:.)"}


@dataclass(frozen=True)
class Sentinels:
    """Marks before prefix, suffix and middle. Each begins with a character that no mark holds at another place, so a mark is found where it was put."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.all()
        if len(set(marks)) < 3 or not all(marks) or any(a[0] in b[1:] for a in marks for b in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("sentinels must differ, must not begin one another, and must begin with a character that occurs nowhere else in them")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(text: str, unit: str) -> list[int] | None:
    """Code-point offsets of the ends of all units, or None if units do not tile the text."""
    found = regex.fullmatch(f"((?>{unit}))*+", text)
    return found.ends(1) if found else None


def _cutter(unit: str):
    out = StructType([StructField("n", LongType()), StructField("first", LongType()), StructField("last", LongType())])

    def cut(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, one, two, strict=True):
            ends = unit_ends(text, unit)
            if ends is None:
                rows.append((None, None, None))
                continue
            low, high = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
            rows.append((len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0))
        return pd.DataFrame(rows, columns=["n", "first", "last"]).astype("Int64")

    return F.pandas_udf(cut, out)


def _hash(id_col: Column, seed: int, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def restore(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that was transformed to `output`."""
    p, s, m = (F.lit(x) for x in marks.all())
    p_at, s_at, m_at = (F.instr(output, x) for x in (p, s, m))

    def between(start: Column, mark: Column, end: Column) -> Column:
        at = start + F.length(mark)
        return F.substring(output, at, end - at)

    end = F.length(output) + 1
    psm = F.concat(between(p_at, p, s_at), between(m_at, m, end), between(s_at, s, m_at))
    spm = F.concat(between(p_at, p, m_at), between(m_at, m, end), between(s_at, s, p_at))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: Sentinels = Sentinels()) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for each row of docs; `row` is the row itself."""
    text, key = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), F.col(f"row.`{id_col}`")
    cut = _cutter(UNITS[unit])
    rows = packed(docs).withColumn("at", cut(text, _hash(key, seed, 0), _hash(key, seed, 1)))
    held = [F.contains(text, F.lit(x)) for x in marks.all()]
    plain = (text == "") | held[0] | held[1] | held[2] | F.col("at.n").isNull() | (_hash(key, seed, 2) % 100 >= percent)
    form = F.when(plain, "plain").when(_hash(key, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = with_once(rows, form=form)
    first, last = F.col("at.first").cast("int"), F.col("at.last").cast("int")
    p, s, m = (F.lit(x) for x in marks.all())
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, last - first), F.substring(text, last + 1, F.length(text) - last)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut_at = F.col("form") != "plain"
    return rows.select("row", F.coalesce("at.n", F.lit(0)).alias("n"), "form", F.when(cut_at, F.col("at.first")).alias("prefix_chars"), F.when(cut_at, F.col("at.last") - F.col("at.first")).alias("middle_chars"), output.alias("output"))


def digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """What the query returns: each row's cut, the digest of its output and that of the text rebuilt from it."""
    marks = options.get("marks", Sentinels())
    done = with_once(transform(docs, id_col, **options), output=F.col("output"))
    sha = [F.sha2(x, 256) for x in (F.col("output"), restore(F.col("output"), F.col("form"), marks))]
    return done.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha[0].alias("output_sha256"), sha[1].alias("restored_sha256"))
