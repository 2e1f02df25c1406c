"""Personal data in Dutch letters: e-mail, IBAN, phone, postcode and citizen number (BSN).

Kept on purpose: a postcode's optional house number may take the first digits of a phone number
that follows it, whereupon the phone span is dropped; a year before two capitals looks like a
postcode; numbers with a three-digit area code and a separator do not match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.spans import find_spans, replace_spans, resolve_overlaps, starts_inside

# What counts as each kind of personal data. (?U) gives \w, \d, \s and \b their Unicode meaning.
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IBAN = r"(?iuU)\bNL\d{2}\s?[A-Z]{4}(?:\s?\d{4}){2}\s?\d{2}\b"
AREA_CODES = "1[035]|2[0-6]|3[035-8]|4[03-6]|5[035-8]|7[0-9]|8[478]"
PHONE = (
    r"(?U)(?<!\w)(?:"
    r"(?:\+31|0031)\s?-?\s?6\s?-?\s?\d{8}"
    rf"|(?:\+31|0031)\s?-?\s?(?:{AREA_CODES})\s?-?\s?\d{{6,7}}"
    r"|06\s?-?\s?\d{8}"
    rf"|0(?:{AREA_CODES})\s?-?\s?\d{{6,7}}"
    r"|0(?:800|900)\s?-?\s?\d{4,7}"
    r")(?!\w)"
)
POSTCODE = r"(?U)\b\d{4}\s?[A-Z]{2}(?:\s+\d{1,5}[a-zA-Z]?)?\b"
NINE_DIGITS = r"(?U)\b\d{9}\b"
BSN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, -1)


def is_valid_bsn(digits: Column) -> Column:
    """The 11-test: nine digits whose weighted sum is a multiple of 11. Null and other texts are false."""
    numbers = F.transform(F.split(digits, ""), lambda d: d.cast("int"))
    products = F.zip_with(numbers, F.array(*[F.lit(w) for w in BSN_WEIGHTS]), lambda d, w: d * w)
    total = F.aggregate(products, F.lit(0), lambda a, x: a + x)
    return F.when(digits.rlike("^[0-9]{9}$"), total % 11 == 0).otherwise(False)


def is_valid_iban_nl(iban: Column) -> Column:
    """Mod-97: without white space and in capitals, the rearranged number leaves 1."""
    plain = F.upper(F.regexp_replace(iban, r"(?U)\s+", ""))
    turned = F.concat(F.substring(plain, 5, 14), F.substring(plain, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.array_join(digits, "").cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")
    return F.when(plain.rlike("^NL[0-9]{2}[A-Z]{4}[0-9]{10}$"), rest == 1).otherwise(False)


def _has_digits(text: Column) -> Column:
    """All kinds but e-mail have two digits in a row."""
    return text.rlike(r"(?U)\d\d")


def find_emails(text: Column) -> Column:
    return find_spans(text, EMAIL, "EMAIL", "[EMAIL]", 0, F.contains(text, F.lit("@")))


def find_ibans(text: Column) -> Column:
    return F.filter(find_spans(text, IBAN, "IBAN", "[IBAN]", 1, _has_digits(text)), lambda s: is_valid_iban_nl(s["original"]))


def find_phones(text: Column) -> Column:
    return find_spans(text, PHONE, "TELEFOON", "[TELEFOON]", 2, _has_digits(text))


def find_postcodes(text: Column) -> Column:
    return find_spans(text, POSTCODE, "POSTCODE", "[POSTCODE]", 3, _has_digits(text))


def find_bsns(text: Column, excluded: Column) -> Column:
    """Valid numbers that do not start inside an excluded range."""
    found = find_spans(text, NINE_DIGITS, "BSN", "[BSN]", 4, _has_digits(text))
    return F.filter(found, lambda s: is_valid_bsn(s["original"]) & ~starts_inside(s, excluded))


def find_pii(text: Column) -> Column:
    """All spans in order without overlaps. Excluded ranges are those found before overlaps are resolved."""
    first = F.concat(find_emails(text), find_ibans(text), find_phones(text), find_postcodes(text))
    return resolve_overlaps(F.concat(first, find_bsns(text, first)))


def redact(text: Column, spans: Column) -> Column:
    return replace_spans(text, spans)
