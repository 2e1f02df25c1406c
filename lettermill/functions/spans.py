"""Spans of a regular expression as array columns, with code-point offsets and an exclusive end.

Spark returns matches without positions. A replacement that puts a mark around each match, split at
the marks, returns the matches and what lies between them; a fold over these gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: neg_end precedes the rest so that sorting gives (start, longest first, finder's rank).
SPAN = "struct<start:int,neg_end:int,rank:int,pattern:string,original:string,placeholder:string>"
NO_SPANS = f"array<{SPAN}>"
#: A control character that letters do not hold; texts that do are scanned twice.
MARK = "\u0001"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def _marked(text: Column, pattern: str) -> Column:
    """array<struct<piece, is_hit>> by one scan: every match gets a mark before and after it, the marks split the text."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.transform(pieces, lambda x, i: F.struct(x.alias("piece"), (i % 2 == 1).alias("is_hit")))


def _interleaved(text: Column, pattern: str) -> Column:
    """The same for texts that hold the mark: what lies between the matches, and the matches, by two scans."""
    between = F.transform(F.split(text, pattern, -1), lambda x, i: F.struct((2 * i).alias("at"), x.alias("piece"), F.lit(False).alias("is_hit")))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, i: F.struct((2 * i + 1).alias("at"), x.alias("piece"), F.lit(True).alias("is_hit")))
    return F.transform(F.array_sort(F.concat(between, hits)), lambda x: F.struct(x["piece"], x["is_hit"]))


def find_spans(text: Column, pattern: str, name: str, placeholder: str, rank: int = 0, hint: Column | None = None) -> Column:
    """All matches of `pattern` in order, by one scan of the text.

    `hint` is a cheaper test that every text with a match passes.
    """

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x["piece"])
        span = F.struct(state["at"].alias("start"), (-end).alias("neg_end"), F.lit(rank).alias("rank"), F.lit(name).alias("pattern"), x["piece"].alias("original"), F.lit(placeholder).alias("placeholder"))
        return F.struct(end.alias("at"), F.when(x["is_hit"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    pieces = F.when(F.contains(text, F.lit(MARK)), _interleaved(text, pattern)).otherwise(_marked(text, pattern))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    test = text.isNotNull() if hint is None else hint
    return F.when(test, F.aggregate(pieces, start, step, lambda s: s["out"])).otherwise(no_spans())


def starts_inside(span: Column, ranges: Column) -> Column:
    """True if the span starts inside one of the ranges."""
    return F.exists(ranges, lambda r: (r["start"] <= span["start"]) & (span["start"] < -r["neg_end"]))


def resolve_overlaps(spans: Column) -> Column:
    """Spans by (start, longest first); each one that starts before the last kept end goes."""

    def step(state: Column, s: Column) -> Column:
        kept = F.struct((-s["neg_end"]).alias("end"), F.concat(state["out"], F.array(s)).alias("out"))
        return F.when(s["start"] >= state["end"], kept).otherwise(state)

    start = F.struct(F.lit(-1).alias("end"), no_spans().alias("out"))
    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), start, step, lambda s: s["out"]))


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with each span (in order, without overlaps) replaced by its placeholder."""

    def cut(s: Column, i: Column) -> Column:
        at = F.when(i > 0, -F.get(spans, i - 1)["neg_end"]).otherwise(0)
        return F.concat(F.substring(text, at + 1, s["start"] - at), s["placeholder"])

    rest = F.substring(text, F.lit(1) - F.element_at(spans, -1)["neg_end"], F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(spans, cut), ""), rest))


def public(spans: Column) -> Column:
    """array<struct<pattern, original, placeholder, start, end>>."""
    return F.transform(spans, lambda s: F.struct(s["pattern"], s["original"], s["placeholder"], s["start"], (-s["neg_end"]).alias("end")))
