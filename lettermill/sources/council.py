"""Council documents: landed search-hit pages (JSON) to flat rows, and the filter for citizens' letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.once import with_once
from lettermill.functions.text import any_phrase, join_text_parts, municipality, strip

# Phrases of citizens' letters, telling parts of file names, and names that are no letters.
LETTER_PHRASES = ("ingekomen stuk", "ingekomen brief", "brief van inwoner", "brief van bewoner", "burgerbrief", "klacht aan de raad", "burgerinitiatief", "ingekomen klacht", "schrijven van")
FILE_PARTS = ("ingekomen", "brief", "klacht", "burgerinitiatief", "zienswijze")
EXCLUDED_NAMES = ("agendabundel", "presentatie", "raadsbesluit", "begroting", "jaarrekening")
MIN_CHARS, MAX_CHARS = 200, 20_000

SOURCE = "struct<name:string,url:string,file_name:string,content_type:string,original_url:string,text:string>"
PAGE = f"hits struct<hits:array<struct<_id:string,_index:string,_score:double,_source:{SOURCE}>>>"


def hits(pages: DataFrame, page_col: str = "page", order_col: str = "page_no") -> DataFrame:
    """(id, index, score, name, url, file_name, content_type, original_url, text) of each hit.

    Of hits with one id the first by page and place stays; hits without an id are all kept. text is
    the raw JSON value: a string, or an array if it starts with [ and parses as one. Places of ids
    alone are grouped; the texts meet them by place, which no two hits share.
    """
    page = F.from_json(F.col(page_col), PAGE)
    rows = pages.select(F.col(order_col).alias("_page"), F.posexplode_outer(page["hits"]["hits"]).alias("_pos", "hit")).where("hit is not null")
    place = F.struct("_page", "_pos")
    first = rows.where("hit._id is not null").groupBy("hit._id").agg(F.min(place).alias("p"))
    first = first.select(F.col("p._page").alias("_page"), F.col("p._pos").alias("_pos"), F.lit(True).alias("is_first"))
    kept = rows.join(first, ["_page", "_pos"], "left").where("is_first or hit._id is null")
    return kept.select(F.col("hit._id").alias("id"), F.col("hit._index").alias("index"), F.col("hit._score").alias("score"), "hit._source.*")


def body(text: Column) -> Column:
    """One string of a text value that is a string or a list of strings."""
    parts = F.from_json(text, "array<string>")
    is_list = F.startswith(strip(text), F.lit("[")) & parts.isNotNull()
    return F.coalesce(F.when(is_list, join_text_parts(parts)).otherwise(strip(text)), F.lit(""))


def letter_score(text: Column, name: Column, file: Column, extra: Sequence[str] = ()) -> Column:
    """Number of clauses that hold: phrases in text, phrases in name, parts in the file name."""
    phrases = (*LETTER_PHRASES, *extra)
    score = F.coalesce(any_phrase(text, phrases), F.lit(0)) + F.coalesce(any_phrase(name, phrases), F.lit(0))
    for part in FILE_PARTS:
        score = score + F.when(F.contains(F.lower(file), F.lit(part)), 1).otherwise(0)
    return score


def citizen_letters(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Documents with at least one clause and no excluded name; adds match_count."""
    excluded = F.coalesce(any_phrase(F.col("name"), EXCLUDED_NAMES), F.lit(0)) > 0
    scored = with_once(docs.where(~excluded), match_count=letter_score(F.col("text"), F.col("name"), F.col("file_name"), extra))
    return scored.where(F.col("match_count") > 0)


def length_reason(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """kept, too_short or too_long."""
    n = F.length(text)
    return F.when(n < min_chars, "too_short").when(n > max_chars, "too_long").otherwise("kept")


def documents(found: DataFrame) -> DataFrame:
    """Flat council documents with municipality, joined text, its length and the length verdict; a match_count stays."""
    rows = found.select(*[c for c in ("match_count",) if c in found.columns], "id", municipality(F.col("index")).alias("gemeente"), "score", "name", "file_name", "content_type", F.coalesce(F.nullif("original_url", F.lit("")), F.col("url")).alias("url"), body(F.col("text")).alias("text"))
    return rows.withColumn("text_length", F.length("text")).withColumn("length_verdict", length_reason(F.col("text")))
