"""Text helpers, law-article references, generated-text clean-up and name parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() sees it: Unicode's and the four separators U+001C..U+001F.
_SPACE = r"[\s\x1C-\x1F]"

# Articles of the administrative-law act that indicate a label.
ARTICLE_LABELS = {
    "1:3": ("aanvraag",),
    "3:11": ("informatieverzoek_3_11",),
    "3:15": ("zienswijze",),
    "4:1": ("aanvraag",),
    "4:8": ("zienswijze",),
    "6:4": ("bezwaar",),
    "6:5": ("bezwaar",),
    "6:6": ("bezwaar",),
    "7:1": ("bezwaar",),
    "9:1": ("klacht",),
    "9:8": ("klacht",),
}
# Forms of a reference to an article and to the information act.
ARTICLE = r"(?iuU)\b(?:artikel|art\.?)\s*(\d+):(\d+[a-z]?)"
ARTICLE_NUMBER = r"(?iuU)\d+:\d+[a-z]?\z"
INFORMATION_ACT = r"(?iuU)\b(?:Wet\s+open\s+overheid|Woo)\b"
# Openings that models put before a letter, and openings that show there is no letter.
LETTER_PREFIXES = ("Brief:", "Bericht:", "Tekst:", "Hier is mijn bericht:")
META_OPENINGS = ("ik kan", "als ai", "natuurlijk", "zeker,")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """White space runs become one space; the ends are stripped."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def cited_articles(text: Column) -> Column:
    """Relevant articles a text refers to, each once, sorted as strings. A letter suffix is part of the article."""
    # one scan for whole references, of which the number is the end
    found = F.transform(F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(0)), lambda x: F.regexp_extract(x, ARTICLE_NUMBER, 0))
    relevant = F.array(*[F.lit(a) for a in ARTICLE_LABELS])
    return F.array_sort(F.array_intersect(F.coalesce(found, F.array().cast("array<string>")), relevant))


def cites_information_act(text: Column) -> Column:
    return F.coalesce(text.rlike(INFORMATION_ACT), F.lit(False))


def has_relevant_signal(articles: Column, information_act: Column) -> Column:
    return (F.size(articles) > 0) | F.coalesce(information_act, F.lit(False))


def labels_of_articles(articles: Column) -> Column:
    """Labels that cited articles indicate, in their order, each once."""
    table = F.create_map(*[x for a, ls in ARTICLE_LABELS.items() for x in (F.lit(a), F.array(*[F.lit(v) for v in ls]))])
    return F.array_distinct(F.flatten(F.transform(articles, lambda a: F.coalesce(F.try_element_at(table, a), F.array().cast("array<string>")))))


def iso_date(text: Column) -> Column:
    """The first ten characters as a date, else null."""
    day = F.substring(strip(text), 1, 10)
    return F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def clean_generated(text: Column) -> Column:
    """A model's letter without fences, wrapping quotes, known prefixes and runs of blank lines."""
    out = strip(F.regexp_replace(strip(text), r"^```[a-zA-Z]*\n?|\n?```\z", ""))
    for quote in ('"', "'"):
        out = F.regexp_replace(out, f"^{quote}+|{quote}+\\z", "")
    out = strip(out)
    for prefix in LETTER_PREFIXES:
        cut = strip(F.substring(out, len(prefix) + 1, F.length(out)))
        out = F.when(F.startswith(F.lower(out), F.lit(prefix.lower())), cut).otherwise(out)
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def is_valid_generation(text: Column, min_chars: int = 30, max_chars: int = 4000) -> Column:
    openings = [F.startswith(F.lower(text), F.lit(p)) for p in META_OPENINGS]
    meta = openings[0]
    for o in openings[1:]:
        meta = meta | o
    return F.coalesce(F.length(text).between(min_chars, max_chars) & (text != "") & ~meta, F.lit(False))


def join_text_parts(parts: Column) -> Column:
    """Stripped non-empty parts joined by a blank line; null gives ''."""
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(strip(F.array_join(F.transform(kept, strip), "\n\n")), F.lit(""))


def municipality(index_name: Column) -> Column:
    """ori_<name>_<time stamp> -> <name>; null for other names."""
    parts = F.split(index_name, "_")
    name = F.array_join(F.slice(parts, 2, F.size(parts) - 2), "_")
    return F.when(F.startswith(index_name, F.lit("ori_")) & (F.size(parts) >= 3), name)


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Number of the phrases that occur as whole words in any case. Texts without any are scanned once."""
    import re

    one = lambda p: text.rlike(rf"(?iuU)\b(?:{p})\b")
    escaped = [re.escape(p) for p in phrases]
    total = F.lit(0)
    for p in escaped:
        total = total + F.when(one(p), 1).otherwise(0)
    return F.when(one("|".join(escaped)), total).otherwise(0)
