"""Ruling XML, article references, quote extraction, suggestions and scores."""

import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions import quotes
from lettermill.functions import text as T
from lettermill.operators import candidates
from lettermill.sources import rulings

LONG = "Ik begrijp niet waarom mijn schuur weg moet, want hij staat er al twintig jaar en niemand heeft er last van gehad."


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("text, want", [("Zie artikel 9:1 en art. 6:5, Artikel 9:1 lid 2", ["6:5", "9:1"]), ("art 4:8", ["4:8"]), ("artikel 6:5a en artikel 2:1", []), ("", []), (None, [])])
def test_articles(spark, text, want):
    assert one(spark, text, T.cited_articles) == want


@pytest.mark.parametrize("text, want", [("de Wet  open overheid", True), ("een WOO-verzoek", True), ("Woonplaats", False), (None, False)])
def test_information_act(spark, text, want):
    assert one(spark, text, T.cites_information_act) is want


def test_labels_of_articles(spark):
    df = spark.createDataFrame([(["6:4", "6:6", "9:8", "2:1"],)], "a array<string>")
    assert df.select(T.labels_of_articles(F.col("a"))).first()[0] == ["bezwaar", "klacht"]


XML = """<r xmlns:dcterms="http://purl.org/dc/terms/" xmlns:psi="http://psi.rechtspraak.nl/" xmlns:rs="http://www.rechtspraak.nl/schema/rechtspraak-1.0">
<dcterms:creator> Rechtbank </dcterms:creator><dcterms:date>2024-03-05T00:00</dcterms:date><dcterms:subject></dcterms:subject><psi:zaaknummer>A/1</psi:zaaknummer>
<rs:inhoudsindicatie>Samenvatting</rs:inhoudsindicatie><rs:uitspraak><para>Gelet op art. 7:1</para>
<para>en <em>de Woo</em> beslist.</para></rs:uitspraak></r>"""


def test_ruling_xml(spark):
    rows = [("E1", XML), ("E2", "<r><open>"), ("E3", ""), ("E4", None), ("E5", "<r><date>gisteren</date><uitspraak> </uitspraak></r>")]
    got = {r.ecli: r for r in rulings.parse_rulings(spark.createDataFrame(rows, "ecli string, xml string")).collect()}
    r = got["E1"]
    assert (r.instance, r.decision_date, r.subject, r.case_number, r.summary) == ("Rechtbank", datetime.date(2024, 3, 5), None, "A/1", "Samenvatting")
    assert (r.full_text, r.awb_articles_cited, r.woo_cited, r.content_url[-4:]) == ("Gelet op art. 7:1 en de Woo beslist.", ["7:1"], True, "d=E1"[-4:])
    for e in ("E2", "E3", "E4", "E5"):
        assert (got[e].full_text, got[e].decision_date, got[e].awb_articles_cited, got[e].woo_cited) == (None, None, [], False)
    frame = rulings.parse_rulings(spark.createDataFrame(rows, "ecli string, xml string"))
    assert rulings.relevant(frame).count() == 1 and rulings.relevant(frame, keep_all=True).count() == 5
    assert rulings.with_content(frame, "2024-03-05", "2024-03-05").count() == 1 and rulings.with_content(frame, "2024-03-06", "2024-12-31").count() == 0


def test_feed_ids_and_files(spark, tmp_path):
    pages = [('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id> A </id></entry><entry><id>B</id></entry><entry/></feed>',), ("<feed><entry><id>A</id></entry><entry><id> </id></entry></feed>",), ("<feed",), (None,)]
    assert sorted(r.ecli for r in rulings.feed_ids(spark.createDataFrame(pages, "xml string")).collect()) == ["A", "B"]
    (tmp_path / "ECLI_NL_1.xml").write_text(XML)
    assert rulings.read_xml_files(spark, str(tmp_path)).first().ecli == "ECLI:NL:1"


def quotes_in(spark, text):
    return one(spark, text, quotes.extract)


def test_quotes(spark):
    text = f"Eiseres heeft het volgende aangevoerd: “{LONG}” De rechtbank beslist over artikel 6:5a."
    (q,) = quotes_in(spark, text)
    assert q.quote == LONG and q.quote_start_in_text == text.index("“") and q.preceding_context == "Eiseres heeft het volgende aangevoerd:"
    assert q.suggested_labels == ["bezwaar"] and q.suggestion_reason == "art 6:5"
    two = quotes_in(spark, text + f' Klager schrijft: "{LONG}"')
    assert len(two) == 2
    assert quotes_in(spark, f"Iemand zei: “{LONG}”") == [] and quotes_in(spark, "Eiseres schrijft: “te kort”") == [] and quotes_in(spark, "") == [] and quotes_in(spark, None) == []
    assert quotes_in(spark, f"Eiseres schrijft: '{LONG}'") == []
    assert quotes_in(spark, "Eiseres schrijft. " + "x" * 400 + f" “{LONG}”") == []
    assert len(quotes_in(spark, f"Eiseres schrijft: “{'a' * 1500}”")) == 1 and quotes_in(spark, f"Eiseres schrijft: “{'a' * 1501}”") == []


@pytest.mark.parametrize(
    "context, labels, reason",
    [
        ("artikel 9:1 en artikel 9:8", ["klacht"], "art 9:1"),
        ("op grond van de Woo", ["woo_verzoek"], "Woo-referentie"),
        ("haar bezwaarschrift en zienswijze", ["bezwaar", "zienswijze"], "woord 'bezwaarschrift'; woord 'zienswijze'"),
        ("art. 6:4; het bezwaarschrift", ["bezwaar"], "art 6:4"),
        ("niets", [], "geen specifiek signaal"),
    ],
)
def test_suggestions(spark, context, labels, reason):
    got = one(spark, context, quotes.suggest)
    assert [g.label for g in got] == labels and ("; ".join(g.reason for g in got) or quotes.NO_REASON) == reason


def brute_score(quote):
    import re

    n = len(quote)
    s = 0.5 - 0.15 * len(re.findall(quotes.JUDGE_WORDS.replace("(?iuU)", "(?i)"), quote))
    s += min(0.3, 0.05 * len(re.findall(quotes.FIRST_PERSON.replace("(?iuU)", "(?i)"), quote)))
    s += 0.2 if 100 <= n <= 500 else 0.1 if 80 <= n <= 800 else 0
    s += 0.15 if re.search(quotes.LETTER_PHRASE.replace("(?iuU)", "(?i)"), quote) else 0
    s -= 0.1 if re.search(quotes.STATUTE.replace("(?iuU)", "(?i)"), quote) and n < 250 else 0
    return max(0.0, min(1.0, s))


@pytest.mark.parametrize("quote", [LONG, "De rechtbank overweegt naar het oordeel van het college dat artikel 5 geldt.", "Geachte heer, " + "ik en mijn hond " * 8, "x" * 90, "x" * 600, "x" * 900, ""])
def test_score(spark, quote):
    assert one(spark, quote, quotes.quality_score) == brute_score(quote)


def test_candidate_table(spark):
    base = ("u", "Rb", datetime.date(2024, 1, 1), "s")
    rows = [("E1", *base, f"Eiseres schrijft: “{LONG}”"), ("E2", *base, None), ("E3", *base, "Eiseres schrijft: “De rechtbank, het college, de afdeling en verweerder overweegt dat dit zo is en blijft.”"), ("E4", *base, f"Klager stelt: “{LONG * 3}” en zijn klachtschrift")]
    found = candidates.candidates(spark.createDataFrame(rows, "ecli string, content_url string, instance string, decision_date date, subject string, full_text string"))
    got = {r.ecli: r for r in found.collect()}
    assert set(got) == {"E1", "E4"} and got["E1"].labels == [] and got["E1"].id.startswith("rcs-") and len(got["E1"].id) == 14
    assert {r.label: r.n for r in candidates.suggestion_counts(found).collect()} == {"__geen_suggestie__": 1, "klacht": 1}
    assert sum(r.n for r in candidates.score_bands(found).collect()) == 2
    assert candidates.for_review(found, 1).count() == 1
    labelled = found.withColumn("labels", F.when(F.col("ecli") == "E1", F.array(F.lit("bezwaar"))).otherwise(F.array().cast("array<string>")))
    assert [(r.text, r.source, r.labels) for r in candidates.to_examples(labelled).collect()] == [(LONG, "rechtspraak", ["bezwaar"])]


def test_patterns_of_quotes_find_what_their_plain_forms_find(spark):
    """The forms that are quick at every character have the same matches; the quick one has to be quick, too."""
    import random
    import time

    plain = {
        quotes.QUOTED: "[\"‘“„»‹][^\"’”«›]{50,1500}+[\"’”«›]",
        quotes.JUDGE_WORDS: r"(?iuU)\b(?:appellant|eiseres|de\s+rechtbank|de\s+afdeling|college|verweerder|is\s+van\s+oordeel|naar\s+het\s+oordeel|overweegt|conclude(?:ert|ren))\b",
        quotes.FIRST_PERSON: r"(?iuU)\b(?:ik|mijn|mij|me|wij|ons|onze)\b",
    }
    rng = random.Random(3)
    words = ["appellant", "Eiseres", "de  Rechtbank", "COLLEGE", "ık", "İK", "ik", "Mijn", "é", "onſ", "naar het oordeel", "x" * 30, "😀", "\x7f", "\n"]
    rows = [("".join(rng.choice([*words, *"\"‘“„»‹’”«›", " ", " ", " "]) for _ in range(rng.randint(0, 60))),) for _ in range(400)]
    texts = spark.createDataFrame(rows, "t string").persist()
    for new, old in plain.items():
        found = texts.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for p, n in ((new, "new"), (old, "old"))])
        assert found.where("new <> old").count() == 0 and found.where("size(new) > 0").count() > 10
    long = spark.range(4000).select(F.repeat(F.concat(F.lit("“een brief van iemand, "), F.col("id").cast("string")), 60).alias("t")).persist()
    long.count()
    seconds = []
    for p in (quotes.QUOTED, plain[quotes.QUOTED]):
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            long.agg(F.sum(F.regexp_count("t", F.lit(p)))).collect()
            runs.append(time.perf_counter() - began)
        seconds.append(min(runs))
    assert seconds[0] < seconds[1] / 2


def test_ruling_xml_is_read_whole(spark):
    rows = [
        ("E1", "<r><uitspraak>een <![CDATA[<twee>]]> drie<!-- x --> vier</uitspraak><creator>A<![CDATA[B]]></creator></r>"),
        ("E2", "<r><creator>A</creator></r> rest"),
        ("E3", "<r><creator>A</creator></r><r/>"),
        ("E4", "﻿<r><p:creator> A </p:creator><k><creator>B</creator></k></r>"),
        ("E5", f"<r><uitspraak>{'é' * 20000}</uitspraak></r>"),
    ]
    got = {r.ecli: (r.instance, r.full_text) for r in rulings.parse_rulings(spark.createDataFrame(rows, "ecli string, xml string")).collect()}
    assert got == {"E1": ("AB", "een <twee> drie vier"), "E2": (None, None), "E3": (None, None), "E4": ("A", None), "E5": (None, "é" * 20000)}
    plan = rulings.with_content(rulings.parse_rulings(spark.createDataFrame(rows, "ecli string, xml string")), "2024-01-01", "2024-12-31")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "xpath" not in plan
