"""Personal data: check digits, finders, overlaps, redaction."""

import pytest
from pyspark.sql import functions as F

from lettermill.functions import pii
from lettermill.functions.spans import find_spans, public
from lettermill.operators import redaction


def iban(number: int) -> str:
    rest = int(f"10112310{number:010d}232100") % 97
    return f"NL{98 - rest:02d}ABNA{number:010d}"


def bsn(start: int) -> str:
    return next(s for n in range(start, start + 99) for s in [str(n)] if sum(w * int(d) for w, d in zip(pii.BSN_WEIGHTS, s, strict=True)) % 11 == 0)


GOOD_BSN, BAD_BSN = bsn(345678900), str(int(bsn(345678900)) + 1)


def redacted(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r.text for r in redaction.pseudonymize(df).orderBy("id").collect()]


@pytest.mark.parametrize("value, ok", [(GOOD_BSN, True), (BAD_BSN, False), ("12345678", False), ("1234567890", False), ("12345678a", False), ("", False), (None, False)])
def test_bsn(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(pii.is_valid_bsn(F.col("v"))).first()[0] is ok


@pytest.mark.parametrize("value, ok", [(iban(7), True), (iban(7).lower(), True), (" ".join([iban(7)[:4], iban(7)[4:8], iban(7)[8:]]), True), ("NL00ABNA0000000007", False), ("DE" + iban(7)[2:], False), (iban(7)[:-1], False), (None, False)])
def test_iban(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(pii.is_valid_iban_nl(F.col("v"))).first()[0] is ok


def test_each_kind(spark):
    cases = {
        "Mail naar jan.de-wit+x@mail.voorbeeld.nl graag": "Mail naar [EMAIL] graag",
        "bel 06-12345678 of 06 12345678.": "bel [TELEFOON] of [TELEFOON].",
        "vast 020-1234567, buitenland +31 6 12345678": "vast [TELEFOON], buitenland [TELEFOON]",
        "service 0800-1234": "service [TELEFOON]",
        "geen kengetal 099-1234567": "geen kengetal 099-1234567",
        "zaak A06-12345678": "zaak A06-12345678",
        "woon in 1234AB of 1234 AB 12b": "woon in [POSTCODE] of [POSTCODE]",
        f"rekening {iban(99)} en NL00ABNA0000000007": "rekening [IBAN] en NL00ABNA0000000007",
        f"nummers {GOOD_BSN} en {BAD_BSN}": f"nummers [BSN] en {BAD_BSN}",
        "é jan@x.nl é": "é [EMAIL] é",
        "niets te zien": "niets te zien",
    }
    assert redacted(spark, *cases) == list(cases.values())


def test_mixed_letter_and_kept_quirks(spark):
    assert redacted(spark, f"Ik ({GOOD_BSN}) woon op 1012 AB 3, bel 06-12345678 of mail a@b.nl.") == ["Ik ([BSN]) woon op [POSTCODE], bel [TELEFOON] of mail [EMAIL]."]
    # the house number takes the start of the phone number; a year before capitals is a postcode
    assert redacted(spark, "woon 1234 AB 06-12345678", "in 2024 WM gestart") == ["woon [POSTCODE]-12345678", "in [POSTCODE] gestart"]


def test_bsn_inside_another_span_is_not_counted(spark):
    df = spark.createDataFrame([(f"{GOOD_BSN}@mail.nl", 1)], "text string, id int")
    assert [s.pattern for s in redaction.with_spans(df).first().spans] == ["EMAIL"]


def test_empty_null_flags_audit_and_stats(spark):
    df = spark.createDataFrame([("a", "x@y.nl", None), ("", "06-12345678", "E:1"), ("c", "", None), ("d", None, None), ("e", "ok", None)], "id string, text string, ecli string")
    done = redaction.pseudonymize(df)
    assert [(r.text, r.pseudonymized) for r in done.collect()] == [("[EMAIL]", True), ("[TELEFOON]", True), ("", False), (None, False), ("ok", True)]
    assert [tuple(r) for r in redaction.audit(done, ("id", "ecli")).collect()] == [("a", "EMAIL", "x@y.nl", "[EMAIL]", 0, 6), ("E:1", "TELEFOON", "06-12345678", "[TELEFOON]", 0, 11)]
    assert tuple(redaction.stats(done).first()) == (5, 2, 2)
    assert [tuple(r) for r in redaction.pattern_counts(done).collect()] == [("EMAIL", 1), ("TELEFOON", 1)]


def test_other_text_column_and_streaming_plan(spark, tmp_path):
    df = spark.createDataFrame([("m@n.nl",)], "body string")
    assert redaction.pseudonymize(df, "body").first().body == "[EMAIL]"
    plan = redaction.pseudonymize(df, "body")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_span_offsets_are_code_points(spark):
    df = spark.createDataFrame([("é😀 ab ab",)], "t string")
    got = df.select(public(find_spans(F.col("t"), "ab", "X", "")).alias("s")).first().s
    assert [(s.start, s.end, s.original) for s in got] == [(3, 5, "ab"), (6, 8, "ab")]


def test_letters_of_large_keys_hold_no_citizen_number(spark, tmp_path):
    """From key 113651 on a letter's number has ten digits; its first nine are none, even where they pass the 11-test."""
    from lettermill.queries import pii_audit

    keys = [k for k in range(113_651, 113_800) if sum(w * int(d) for w, d in zip(pii.BSN_WEIGHTS, str(100_000_000 + k * 7919), strict=False)) % 11 == 0]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = pii_audit(spark, str(tmp_path)).collect()
    assert keys and {r.record_id for r in found} == {str(k) for k in keys} and "BSN" not in {r.pattern for r in found}
