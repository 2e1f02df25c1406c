"""Quoted passages of citizens in court rulings: extraction, label suggestion and quality score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.spans import find_spans
from lettermill.functions.text import INFORMATION_ACT, strip

# Words for the citizen and for what introduces a quote; both must precede it.
ACTOR = (
    r"(?iuU)\b(?:appellant(?:e|en)?|eiser(?:es|s)?|verzoeker(?:s)?|verzoekster|klager(?:s)?|klaagster|indiener(?:s)?"
    r"|betrokkene|belanghebbende|bezwaarmaker|bezwaarmaakster)\b"
)
VERB = (
    r"(?iuU)\b(?:schrijft|stelt|voert\s+aan|verzoekt|meldt|geschreven|aangevoerd|gesteld|verzocht|gemeld|geantwoord"
    r"|opgemerkt|naar\s+voren\s+gebracht|geklaagd|verklaard|het\s+volgende|als\s+volgt|onder\s+meer)\b"
)
# Quotation marks that open and close, and the length between them (possessive: no closing mark lies inside).
# Both sets ask for ASCII first, since a set of many signs is tried sign by sign at every character; they are ["‘“„»‹] and [^"’”«›].
QUOTED = "[\"\\x80-\\x{10FFFF}&&[\"‘“„»‹]][\\x00-\\x21\\x23-\\x7F[^\"’”«›]]{50,1500}+[\"’”«›]"
# A judge's words, first-person words, letter phrases, statute text. First letters are looked at before word boundaries, which cost more.
JUDGE_WORDS = r"(?iuU)(?=[acdeinov])\b(?:appellant|eiseres|de\s+rechtbank|de\s+afdeling|college|verweerder|is\s+van\s+oordeel|naar\s+het\s+oordeel|overweegt|conclude(?:ert|ren))\b"
FIRST_PERSON = r"(?iuU)(?=[imow])\b(?:ik|mijn|mij|me|wij|ons|onze)\b"
LETTER_PHRASE = r"(?iuU)\b(?:geachte|geacht\s+college|hierbij|met\s+vriendelijke\s+groet|hoogachtend)\b"
STATUTE = r"(?iuU)\bartikel\s+\d+"
# Articles that suggest a label. The letter suffix of an article is not looked at here.
ARTICLE = r"(?iuU)\b(?:art(?:ikel|\.?)?\s*)(\d+):(\d+)"
SUGGESTS = {"1:3": "aanvraag", "4:1": "aanvraag", "6:4": "bezwaar", "6:5": "bezwaar", "7:1": "bezwaar", "9:1": "klacht", "9:8": "klacht", "3:11": "informatieverzoek_3_11", "3:15": "zienswijze", "4:8": "zienswijze"}
KEYWORDS = (("bezwaarschrift", "bezwaar"), ("klachtschrift", "klacht"), ("zienswijze", "zienswijze"))
NO_REASON = "geen specifiek signaal"

BEFORE, AFTER, SHOWN, MIN_QUOTE = 300, 200, 250, 50

CANDIDATE = "struct<quote:string,preceding_context:string,quote_start_in_text:int,suggested_labels:array<string>,suggestion_reason:string,quality_score:double>"


def has_citizen_context(window: Column) -> Column:
    return window.rlike(ACTOR) & window.rlike(VERB)


def suggest(context: Column) -> Column:
    """array<struct<label, reason>> in the order of first sight, each label once."""
    books = F.regexp_extract_all(context, F.lit(ARTICLE), F.lit(1))
    numbers = F.regexp_extract_all(context, F.lit(ARTICLE), F.lit(2))
    articles = F.zip_with(books, numbers, lambda b, n: F.concat(b, F.lit(":"), n))
    table = F.create_map(*[F.lit(x) for pair in SUGGESTS.items() for x in pair])
    hits = F.transform(articles, lambda a: F.struct(F.try_element_at(table, a).alias("label"), F.concat(F.lit("art "), a).alias("reason")))
    none = F.array().cast("array<struct<label:string,reason:string>>")

    def rule(test: Column, label: str, reason: str) -> Column:
        return F.when(test, F.array(F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason")))).otherwise(none)

    more = [rule(context.rlike(INFORMATION_ACT), "woo_verzoek", "Woo-referentie")]
    more += [rule(F.contains(F.lower(context), F.lit(word)), label, f"woord '{word}'") for word, label in KEYWORDS]
    found = F.filter(F.concat(hits, *more), lambda x: x["label"].isNotNull())

    def first_only(out: Column, x: Column) -> Column:
        return F.when(F.exists(out, lambda y: y["label"] == x["label"]), out).otherwise(F.concat(out, F.array(x)))

    # the first reason for a label stands
    return F.aggregate(found, none, first_only)


def quality_score(quote: Column) -> Column:
    """0..1, higher for a citizen's own words. The order of additions fixes the doubles at the cut-offs."""
    n = F.length(quote)
    score = F.lit(0.5) - F.lit(0.15) * F.regexp_count(quote, F.lit(JUDGE_WORDS))
    score = score + F.least(F.lit(0.3), F.lit(0.05) * F.regexp_count(quote, F.lit(FIRST_PERSON)))
    score = score + F.when(n.between(100, 500), 0.2).when((n >= 80) & (n <= 800), 0.1).otherwise(0.0)
    score = score + F.when(quote.rlike(LETTER_PHRASE), 0.15).otherwise(0.0)
    score = score - F.when(quote.rlike(STATUTE) & (n < 250), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def extract(text: Column) -> Column:
    """array<CANDIDATE> of the quotes that follow an actor and a verb within BEFORE characters."""

    def at(s: Column) -> Column:
        start, end = s["start"], -s["neg_end"]
        before = F.greatest(F.lit(0), start - BEFORE)
        return F.struct(
            strip(F.substring(s["original"], F.lit(2), F.length(s["original"]) - 2)).alias("quote"),
            F.substring(text, before + 1, start - before).alias("context"),
            F.substring(text, before + 1, end + AFTER - before).alias("wide"),
            start.alias("start"),
        )

    def with_hints(x: Column) -> Column:
        # a step of its own, since nothing is shared between uses within a lambda
        return F.struct(x["quote"].alias("quote"), strip(x["context"]).alias("shown"), x["start"].alias("start"), suggest(x["wide"]).alias("hints"))

    def candidate(x: Column) -> Column:
        reasons = F.array_join(F.transform(x["hints"], lambda h: h["reason"]), "; ")
        return F.struct(
            x["quote"].alias("quote"),
            F.when(F.length(x["shown"]) > SHOWN, F.right(x["shown"], F.lit(SHOWN))).otherwise(x["shown"]).alias("preceding_context"),
            x["start"].alias("quote_start_in_text"),
            F.transform(x["hints"], lambda h: h["label"]).alias("suggested_labels"),
            F.coalesce(F.nullif(reasons, F.lit("")), F.lit(NO_REASON)).alias("suggestion_reason"),
            quality_score(x["quote"]).alias("quality_score"),
        )

    found = F.transform(find_spans(text, QUOTED, "QUOTE", ""), at)
    kept = F.filter(found, lambda x: (F.length(x["quote"]) >= MIN_QUOTE) & has_citizen_context(x["context"]))
    return F.coalesce(F.transform(F.transform(kept, with_hints), candidate), F.array().cast(f"array<{CANDIDATE}>"))
