"""Court rulings from landed XML, and identifiers from landed search-feed pages."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.once import with_once
from lettermill.functions.text import cited_articles, cites_information_act, empty_to_null, has_relevant_signal, iso_date, strip

# Fixed value: where a ruling's content lives.
CONTENT_URL = "https://data.rechtspraak.nl/uitspraken/content"
# Local names of the elements that hold a ruling's fields and its text.
_FIELDS = ("creator", "date", "subject", "zaaknummer", "abstract", "inhoudsindicatie")
_BODY = "uitspraak"
_WANTED = {*_FIELDS, _BODY}


def _well_formed(xml: Column) -> Column:
    """xpath functions fail on malformed XML; from_xml reports it instead."""
    checked = F.from_xml(xml, F.lit("c string, _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.coalesce(xml != "", F.lit(False)) & checked["_corrupt_record"].isNull()


def read_ruling(xml: str | None) -> tuple[str | None, ...]:
    """Stripped texts of the first elements of _FIELDS, each up to the element's first child, and all text of the body; null for none.

    A body's pieces are in document order with one space between them. Malformed XML has nulls only.
    """
    texts, seen, pieces, text, opened, depth = {}, set(), [], [], [], 0

    def end_text(*_) -> None:
        if text:
            piece = "".join(text)
            text.clear()
            if opened[-1]:
                texts.setdefault(opened[-1], piece)
            if depth:
                pieces.append(piece)

    def start(name: str, _) -> None:
        nonlocal depth
        end_text()
        name = name[name.rfind(":") + 1 :]
        is_first = name in _WANTED and name not in seen
        seen.add(name)
        opened.append(name if is_first else None)
        depth += bool(depth or is_first and name == _BODY)

    def end(_) -> None:
        nonlocal depth
        end_text()
        opened.pop()
        depth -= bool(depth)

    # name spaces need not be declared
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = end_text
    try:
        parser.Parse(xml or "", True)
    except expat.ExpatError:
        return (None,) * (len(_FIELDS) + 1)
    return (*[texts.get(name, "").strip() or None for name in _FIELDS], " ".join(" ".join(pieces).split()) or None)


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for xml in batches:
        yield pd.DataFrame([read_ruling(x) for x in xml], columns=[*_FIELDS, _BODY])


def parse_rulings(raw: DataFrame, id_col: str = "ecli", xml_col: str = "xml") -> DataFrame:
    """(ecli, xml) to typed rulings. Malformed, empty or null XML gives nulls, no articles and no flag.

    A row's XML is parsed once, by an Arrow UDF: XPath parses it for each expression and walks all of it for each name.
    """
    read = F.pandas_udf(_read, ", ".join(f"{name} string" for name in (*_FIELDS, _BODY)))
    rows = raw.select(F.col(id_col).alias("ecli"), read(F.col(xml_col)).alias("x"))
    typed = with_once(
        rows,
        content_url=F.concat(F.lit(f"{CONTENT_URL}?id="), "ecli"),
        instance=F.col("x.creator"),
        decision_date=iso_date(F.col("x.date")),
        subject=F.col("x.subject"),
        case_number=F.col("x.zaaknummer"),
        summary=F.coalesce("x.abstract", "x.inhoudsindicatie"),
        full_text=F.col(f"x.{_BODY}"),
    )
    return with_signals(typed.drop("x")).withColumn("fetched_at", F.current_timestamp())


def with_signals(rulings: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Add the relevant articles that a ruling cites and whether it cites the information act."""
    return with_once(rulings, awb_articles_cited=cited_articles(F.col(text_col)), woo_cited=cites_information_act(F.col(text_col)))


def relevant(rulings: DataFrame, keep_all: bool = False) -> DataFrame:
    """Rulings with a relevant article or the information act; all of them with keep_all."""
    return rulings if keep_all else rulings.where(has_relevant_signal(F.col("awb_articles_cited"), F.col("woo_cited")))


def with_content(rulings: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Rulings with text and a date in the range, both ends included."""
    return rulings.where(F.col("full_text").isNotNull() & F.col("decision_date").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))


def feed_ids(pages: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(ecli): distinct non-blank entry ids of search-feed pages; malformed pages give none."""
    xml = F.when(_well_formed(F.col(xml_col)), F.col(xml_col))
    ids = F.xpath(xml, F.lit('//*[local-name()="entry"]/*[local-name()="id"]/text()'))
    return pages.select(F.explode(ids).alias("ecli")).select(strip(F.col("ecli")).alias("ecli")).where("ecli <> ''").distinct()


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(ecli, xml): one row a file; the identifier is the file name, with _ for :."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")
    return rows.select(F.replace(F.regexp_replace("file_name", r"\.xml$", ""), F.lit("_"), F.lit(":")).alias("ecli"), F.col("value").alias("xml"))


def read_feed_records(spark: SparkSession, path: str, tag: str = "open-rechtspraak", declarations: str = "") -> DataFrame:
    """(ecli, xml): the records of XML feeds of any size, a row each, as parse_rulings takes them.

    A file is cut at the opening tags of its records, so the tasks share a large one and none holds it
    whole; a feed may also lie in part files that end between records. `declarations` are name spaces that
    only the feed's root declares; every record gets them. A record that is never closed gives no row,
    wherever it stands, and the next one is read; a closing tag inside a comment or CDATA ends a record,
    which then counts as malformed. No element inside a record may have a name that begins with the tag.
    A record's id is its first `identifier`.
    """
    closing = f"</{tag}>"
    rows = spark.read.text(path, lineSep=f"<{tag}").where(F.contains("value", F.lit(closing)) & F.col("value").rlike(r"^[\s>/]"))
    xml = F.concat(F.lit(f"<{tag} {declarations}" if declarations else f"<{tag}"), F.substring_index("value", closing, 1), F.lit(closing))
    rows = with_once(rows, xml=xml).select("xml")
    ecli = empty_to_null(strip(F.regexp_extract("xml", r"<(?:[\w.-]+:)?identifier(?:\s[^>]*)?>([^<]*)<", 1)))
    return rows.select(ecli.alias("ecli"), "xml")
