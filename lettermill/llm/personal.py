"""Personal data by weak supervision: base patterns, and further spans that labelers vote on.

Base spans are the leftmost matches of four fixed patterns that pass a check of their digits; they
always stay. Wider patterns propose candidates of these and further kinds (a card or phone whose digits
run into others', so that the base pattern drops both; obfuscated addresses, local phones, account
numbers, identity numbers, dates, street addresses, names). Base spans are candidates, too, for what
the corpus tells of their kind. Five labelers vote
for (1), against (-1) or not at all (0): the format of the value, gazetteers, cue words before it,
words that speak against it, and how it is placed. Votes are counted by kind and vote pattern; at
most kinds x 3^5 rows, whatever the corpus. Expectation-maximisation on these counts estimates how
each labeler votes on personal data and on the rest; an anchor of ANCHOR of a kind's candidates holds
the meaning of the two classes. A logistic span classifier is trained on all candidates, with their
posteriors as what it should predict, and votes, neighbouring words and the value's shape as
features; so it passes on what the labelers agree on to candidates that look alike, and does not count
features twice that come together. Its weights minimise the cross-entropy by STEPS steps on a bound of
it, each of which is one aggregate over distinct candidates. A candidate whose probability is
MIN_PROBABILITY or more becomes a span, unless it overlaps a base span.

Native: column functions and aggregates only. A text is scanned seven times in one narrow step; what is
written holds spans and candidates, no texts. The model is BUCKETS + 46 numbers for each kind, as
literals. Gradients are added up in millionths as integers, so reruns agree.

Cases: a null text counts as empty and has no spans; texts are scanned whole, and no pattern's time is
more than linear in runs of its characters. Repeated rows give repeated rows, each a vote of its own;
an empty table, or one without candidates, an empty model, which adds nothing. A null id is an id.
The control character U+0001 in texts counts as U+0002, which matches no pattern either. Offsets are
code points, ends exclusive. Only id and text are read; further columns cannot clash.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.once import with_once
from lettermill.llm.common import cut, steps_to_one_table

MARK, INSTEAD = "\u0001", "\u0002"
BEFORE, AFTER = 48, 24
#: Features of a kind that share weights by hash; votes have weights of their own.
BUCKETS = 2048
ROUNDS = 25
ANCHOR = 0.05
MIN_PROBABILITY = 0.8
STEPS, PENALTY = 25, 1.0
MILLION = 1_000_000
#: Each labeler with its assumed probabilities of the votes -1, 0 and 1 on personal data and on the rest: where EM starts, and its anchor.
ASSUMED = {
    "format": ((0.1, 0.2, 0.7), (0.6, 0.35, 0.05)),
    "gazetteer": ((0.1, 0.4, 0.5), (0.45, 0.5, 0.05)),
    "cue": ((0.02, 0.58, 0.4), (0.02, 0.93, 0.05)),
    "counter_cue": ((0.05, 0.93, 0.02), (0.3, 0.68, 0.02)),
    "placement": ((0.05, 0.65, 0.3), (0.2, 0.75, 0.05)),
}
LABELERS = tuple(ASSUMED)
#: Weights of a kind: its votes', its other features' and the constant, which comes last.
WEIGHTS = 3 * len(LABELERS) + BUCKETS + 1
#: Features of a candidate.
FEATURES = len(LABELERS) + 5

# The base patterns. Possessive repeats and the look-behinds change no match; they keep the time linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds in the order of the result: those of the base patterns first.
KINDS = ("email", "ip", "card", "phone", "iban", "id", "birth", "address", "name")

#: Candidates by what they begin with; within a group in the order in which they are tried at a place.
_EDGE, _END = r"(?<![\p{L}0-9_])", r"(?![\p{L}0-9_])"
_CAP = r"\p{Lu}[\p{L}'’-]{1,30}"
_TYPES = "Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square"
CANDIDATES = {
    "digits": {
        "iban": rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
        "card": rf"(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ .-][0-9]{{4}}){{3}}(?:[ .-][0-9]{{1,3}})?|3[47][0-9]{{2}}[ .-][0-9]{{6}}[ .-][0-9]{{5}}){_END}",
        "birth": rf"(?:(?:19|20)[0-9]{{2}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}){_END}",
        "id": rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
        "address": rf"[0-9]{{1,5}}[a-z]?(?: bis)?,? (?:(?:{_CAP} ){{1,3}}(?:{_TYPES}){_END}|(?:rue|avenue|boulevard|place|chemin) (?:d[eu] |des |la |l['’])*{_CAP})",
        "phone": rf"(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,5}}\)[ .-]?)?|\([0-9]{{2,5}}\) ?|0[0-9]{{1,4}}[ ./-]|[2-9][0-9]{{2}}[ .-])[0-9]{{2,4}}(?:[ .-][0-9]{{2,4}}){{1,3}}{_END}",
    },
    "at": {
        "email": rf"[A-Za-z0-9._%+-]{{1,64}}(?: ?[(\[{{]at[)\]}}] ?| at )[A-Za-z0-9-]{{1,63}}(?:(?: ?[(\[{{]dot[)\]}}] ?| dot |\.)[A-Za-z0-9-]{{1,63}}){{1,6}}{_END}",
    },
    "words": {
        "address": rf"(?:\p{{Lu}}[\p{{L}}'’-]{{1,30}}+(?<=straße|strasse|gasse|weg|platz|straat|laan) [0-9]{{1,4}}[a-z]?|(?:[Cc]alle|[Aa]venida|[Pp]laza|[Vv]ia) (?:de |la |del )*{_CAP},? [0-9]{{1,4}}){_END}",
        "name": rf"(?!(?:Dear|Hello|Hi|Contact|Signed|Regards|Sincerely) )(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señora?)\.? )?{_CAP}(?: \p{{Lu}}\.)?(?: {_CAP}){{1,2}}",
    },
}
#: What a candidate of a group begins with, tested before the edge.
FIRST = {"digits": r"(?=[0-9(+]|[A-Z]{2}[0-9])", "at": "(?=[A-Za-z0-9])", "words": r"(?=\p{Lu}|[cavp][aelv])"}
GROUPS = {g: f"{FIRST[g]}{_EDGE}(?:" + "|".join(kinds.values()) + ")" for g, kinds in CANDIDATES.items()}
#: Texts without these have no match. Of addresses written out with `at`, only those with a written dot are candidates.
HINTS = {
    "email": r"@[A-Za-z0-9-]+\.",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "digits": "[0-9]",
    "at": r"[(\[{]at[)\]}]| dot ",
    "words": r"\p{Lu}\p{L}+ \p{Lu}|[0-9]",
}

# Gazetteers, cue words and words that speak against a candidate.
GIVEN_NAMES = (
    "Adam Alan Albert Alice Amanda Amélie Amy Ana Andrea Andrew Angela Anita Anna Anne Antoine Antonio Barbara Bernard Brian Camille Carla Carlos Carmen Carol Caroline "
    "Charles Charlotte Chloé Christian Christine Claire Claudia Daniel David Deborah Diego Donald Edward Elena Elizabeth Ellen Emily Emma Eric Eva Fatima Felix Fernando "
    "Francisco François Frank Gabriel George Hannah Hans Heather Heinz Helen Henry Ines Isabel Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johannes John "
    "Jonas Jorge José Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Lea Leon Linda Lisa Louis Lucas Lucía Luis Manuel Margaret Maria María Marie Mark Markus "
    "Martin Mary Matthew Max Michael Miguel Mohamed Monika Nancy Nicole Nina Olivia Omar Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Richard Robert Rosa Ruth "
    "Sabine Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Steven Susan Thomas Ursula Walter William Wolfgang"
)
#: Capitalised words that start sentences or name times and places rather than persons.
NOT_NAMES = (
    "The This That These Those There Then They When Where What Which While With Without And But For From Into Upon After Before Because However Also Our Your His Her Its "
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "North South East West New United States Street Road University Institute Company License Public General Apache Copyright Der Die Das Ein Eine Und Les Des Une Los Las Una El La Le"
)
TLDS = "com org net edu gov info io de fr es nl uk eu us ch at it be"
#: Countries and lengths of their account numbers.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Addresses that name no person's machine.
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|2(?:2[4-9]|[345][0-9]))\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
CUES = {
    "email": r"mail|contact|write to|reach|kontakt|correo|adresse",
    "card": r"card|visa|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"\btel|phone|call|mobile|\bcell|\bfax|\bring|anruf|appel|llam|móvil|handy",
    "iban": r"iban|account|bank|konto|compte|cuenta|rekening",
    "id": r"\bssn\b|social security|passport|\bid\b|identity|ausweis|identité|identidad",
    "birth": r"\bborn|\bbirth|\bdob\b|geboren|geburt|\bnée?\b|naissance|nacid|nacimiento",
    "address": r"\blive|address|resid|wohn|adresse|dirección|domicil|habite|anschrift|home",
    "name": r"\bname|\bdear|\bsigned|sincerely|regards|contact|\bheiß|\bnom\b|appelle|nombre|llamo|\bmr|\bmrs|\bms\b|\bdr\b|patient|client|customer",
}
COUNTER_CUES = r"version|\brev\b|isbn|order|invoice|\bpage|figure|\bfig\b|\btable|chapter|section|\bitem|\bsku\b|\bpart\b|model|build|\bdoi\b|issue|\bvol\b|price|total|\$|€|£|copyright|license|university|since|until|published"


def _words(words: str, capitals: bool = False) -> Column:
    return F.array(*[F.lit(w if capitals else w.lower()) for w in words.split()])


def luhn(digits: Column) -> Column:
    """True if the digits pass the check: from the right, every second one doubled, digit sums added up."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _hits(text: str, patterns: dict[str, str], hints: dict[str, str], df: DataFrame) -> DataFrame:
    """Add, for each pattern, `h_<name>`: array<struct<value, start, end, before, after>> of its matches, in order; the text goes.

    A replacement marks each match; split at the marks, every second piece is one. Ends are the running sum of the pieces' lengths.
    """
    t = F.col(text)
    rest = [c for c in df.columns if c != text]
    pieces = {f"p_{k}": F.when(t.rlike(hints[k]), F.split(F.regexp_replace(t, p, f"{MARK}$0{MARK}"), MARK, -1)) for k, p in patterns.items()}
    df = with_once(df, **pieces).select(*rest, *pieces)

    def ends(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + F.length(x)
            return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

        return F.aggregate(pieces, start, step, lambda s: s["out"])

    df = with_once(df, **{f"e_{k}": ends(F.col(f"p_{k}")) for k in patterns})

    def hit(k: str):
        p, e = F.col(f"p_{k}"), F.col(f"e_{k}")

        # context reaches over the hits beside this one; each piece is cut to length first, so that the work stays linear
        def before(i: Column) -> Column:
            near = [F.right(F.coalesce(F.get(p, i - d), F.lit("")), F.lit(BEFORE)) for d in (3, 2, 1)]
            return F.right(F.concat(*near), F.lit(BEFORE))

        def after(i: Column) -> Column:
            near = [F.left(F.coalesce(F.get(p, i + d), F.lit("")), F.lit(AFTER)) for d in (1, 2, 3)]
            return F.left(F.concat(*near), F.lit(AFTER))

        return lambda i: F.struct(F.get(p, i).alias("value"), F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), before(i).alias("before"), after(i).alias("after"))

    none = F.array().cast("array<struct<value:string,start:int,end:int,before:string,after:string>>")
    found = {f"h_{k}": F.when(F.size(f"p_{k}") > 1, F.transform(F.sequence(F.lit(1), F.size(f"p_{k}") - 2, F.lit(2)), hit(k))).otherwise(none) for k in patterns}
    return with_once(df, **found).select(*rest, *found)


def _base_ok(kind: str, value: Column) -> Column:
    digits = _only_digits(value)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda x: F.when(F.length(x) > 3, False).otherwise(x.cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _candidate(kind: Column, x: Column, is_base: bool) -> Column:
    return F.struct(kind.alias("kind"), F.lit(is_base).alias("is_base"), *[x[c].alias(c) for c in ("value", "start", "end", "before", "after")])


def _base_spans(kind: str) -> Column:
    return F.transform(F.filter(f"h_{kind}", lambda x: _base_ok(kind, x["value"])), lambda x: _candidate(F.lit(kind), x, True))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _kind_of(group: str, value: Column) -> Column:
    """The first pattern of the group that the whole value matches."""
    *first, last = CANDIDATES[group]
    out = F.lit(last)
    for k in reversed(first):
        out = F.when(value.rlike(f"^(?:{CANDIDATES[group][k]})$"), k).otherwise(out)
    return out


def _proposed(group: str) -> Column:
    return F.transform(f"h_{group}", lambda x: _candidate(_kind_of(group, x["value"]), x, False))


def _apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of those taken."""
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(F.filter(spans, lambda x: ~F.exists(taken, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))


def _valid_iban(value: Column) -> Column:
    """Mod-97 of the rearranged number, nine digits at a time."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda r, c: (r * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _sign(positive: Column, negative: Column) -> Column:
    return F.when(F.coalesce(positive, F.lit(False)), 1).when(F.coalesce(negative, F.lit(False)), -1).otherwise(0)


def _votes(x: Column) -> Column:
    """The five labelers' votes on a candidate with kind, value, before and after."""
    k, value, before, after = (x[n] for n in ("kind", "value", "before", "after"))
    low, digits = F.lower(before), _only_digits(value)
    words = F.split(value, " ")
    date = F.when(value.rlike("^[0-9]{4}"), F.regexp_replace(value, "[./]", "-")).otherwise(F.regexp_replace(value, "^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$", "$3-$2-$1"))
    day = F.try_to_date(date, "y-M-d")
    fine = (
        F.when(k == "iban", _valid_iban(value))
        .when(k == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        .when(k == "id", ~value.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(k == "birth", day.isNotNull() & F.year(day).between(1900, 2020))
        .when(k == "phone", F.length(digits).between(9, 15))
        .when(k == "ip", F.lit(True))
        .when(k == "email", ~F.contains(value, F.lit(" at ")) | value.rlike(" dot "))
        .when(k == "address", value.rlike("[0-9]"))
    )
    v_format = F.when(k == "name", F.when(value.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señora?)\.? "), 1).otherwise(0)).otherwise(_sign(fine, ~fine))
    lengths = F.create_map(*[F.lit(v) for pair in IBAN_LENGTHS.items() for v in pair])
    given = F.exists(words, lambda w: F.array_contains(_words(GIVEN_NAMES, True), w))
    other = F.exists(words, lambda w: F.array_contains(_words(NOT_NAMES, True), w))
    last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    v_list = (
        F.when(k == "name", _sign(given & ~other, other | ~given))
        .when(k == "iban", F.when(F.element_at(lengths, F.substring(value, 1, 2)) == F.length(F.regexp_replace(value, " ", "")), 1).otherwise(-1))
        .when(k == "card", F.when(digits.rlike(ISSUERS), 1).otherwise(-1))
        .when(k == "phone", F.when(value.rlike(COUNTRY_CODES), 1).otherwise(0))
        .when(k == "ip", F.when(value.rlike(RESERVED), -1).otherwise(0))
        .when(k == "email", F.when(F.array_contains(_words(TLDS), last), 1).otherwise(-1))
        .otherwise(0)
    )
    v_cue = F.lit(0)
    for kind, cues in CUES.items():
        v_cue = F.when((k == kind) & low.rlike(cues), 1).otherwise(v_cue)
    v_counter = F.when(F.right(low, F.lit(24)).rlike(COUNTER_CUES) | after.rlike(r"^\s?[%€$]"), -1).otherwise(0)
    v_place = F.when(before.rlike(r"[:=#]\s{0,2}$"), 1).when(before.rlike(r"[\p{L}0-9_/\\.\-]$") | after.rlike(r"^(?:[\p{L}0-9_/\\]|[.\-][0-9])"), -1).otherwise(0)
    return F.array(*[v.cast("int") for v in (v_format, v_list, v_cue, v_counter, v_place)])


def _features(x: Column, votes: Column) -> Column:
    """Numbers of the kind's weights: each labeler's vote, the two words before and one after, the shape of the value, and the constant."""
    before, after = F.lower(x["before"]), F.lower(x["after"])
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["value"], r"\p{Lu}", "A"), r"\p{Ll}+", "a"), "[0-9]", "9")
    words = [F.concat(F.lit("before="), F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1)), F.concat(F.lit("two_before="), F.regexp_extract(before, r"(\p{L}+)\P{L}+\p{L}+\P{L}*$", 1))]
    words += [F.concat(F.lit("after="), F.regexp_extract(after, r"^\P{L}*(\p{L}+)", 1)), F.concat(F.lit("shape="), shape)]
    kind, own = (F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]) - 1).cast("int"), 3 * len(LABELERS)
    voted = F.transform(votes, lambda v, j: 3 * j + v + 1)
    hashed = F.transform(F.array(*words), lambda f: (own + F.pmod(F.xxhash64(f), F.lit(BUCKETS))).cast("int"))
    constant = F.array(F.lit(own + BUCKETS))
    return F.transform(F.concat(voted, hashed, constant), lambda f: kind * WEIGHTS + f)


def extract(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, email, ip, card, phone, candidates): the rows of docs (or their columns `keep`), their base spans (start, end) by kind, and what is voted on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, INSTEAD)).otherwise(text)
    rows = docs.select(F.struct(*[F.col(c) for c in keep or docs.columns]).alias("row"), text.alias("t"))
    found = _hits("t", BASE | GROUPS, HINTS, rows)
    found = with_once(found, **{k: _base_spans(k) for k in BASE}, **{g: _proposed(g) for g in GROUPS})
    found = found.select("row", *BASE, *GROUPS)
    # a base span outranks candidates, and a group the groups after it
    taken = F.concat(*[_places(F.col(k)) for k in BASE])
    for g in GROUPS:
        found = with_once(found, **{g: _apart(F.col(g), taken)})
        taken = F.concat(taken, _places(F.col(g)))
    found = with_once(found, more=F.concat(*[F.col(c) for c in (*BASE, *GROUPS)]))
    kept = lambda x, *more: F.struct(x["kind"].alias("kind"), x["is_base"].alias("is_base"), x["start"].alias("start"), x["end"].alias("end"), *more)
    found = with_once(found, more=F.transform("more", lambda x: kept(x, _votes(x).alias("votes"), x.alias("x"))))
    out = F.transform("more", lambda x: kept(x, x["votes"].alias("votes"), _features(x["x"], x["votes"]).alias("features")))
    return found.select("row", *[_places(F.col(k)).alias(k) for k in BASE], out.alias("candidates"))


# ---------------------------------------------------------------- the model


def vote_patterns(extracted: DataFrame) -> DataFrame:
    """(kind, votes, n): how many candidates of a kind got these votes."""
    each = extracted.select(F.explode("candidates").alias("c"))
    return each.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))


def _likelihood(prior: Column, table: Column, votes: Column) -> Column:
    """ln of the prior times each labeler's probability of its vote; `table` holds three numbers a labeler, for -1, 0 and 1."""
    terms = F.transform(votes, lambda v, j: F.ln(F.get(table, 3 * j + v + 1)))
    return F.aggregate(terms, F.ln(prior), lambda a, x: a + x)


def _posterior(model: Column, votes: Column) -> Column:
    return 1 / (1 + F.exp(_likelihood(1 - model["prior"], model["no"], votes) - _likelihood(model["prior"], model["yes"], votes)))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, model): prior share of personal data, and each labeler's vote probabilities on it (`yes`) and on the rest (`no`).

    Expectation-maximisation by a fold over each kind's vote patterns, of which there are 3^5 at most.
    """
    size = 3 * len(LABELERS)
    fixed = {c: F.array(*[F.lit(x) for p in tables for x in p]) for c, tables in zip(("yes", "no"), zip(*ASSUMED.values(), strict=True), strict=True)}
    first = F.struct(F.lit(0.2).alias("prior"), fixed["yes"].alias("yes"), fixed["no"].alias("no"))

    def step(model: Column, pats: Column) -> Column:
        # bind the responsibilities once, then add them up for every labeler and vote
        shared = F.transform(pats, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * _posterior(model, x["votes"])).alias("yes")))
        total = lambda r, f: F.aggregate(r, F.lit(0.0), lambda a, x: a + f(x))
        parts = {"yes": lambda x: x["yes"], "no": lambda x: x["n"] - x["yes"]}

        def update(r: Column) -> Column:
            n = total(r, lambda x: x["n"].cast("double"))

            def estimates(c: str) -> Column:
                mine = total(r, parts[c])

                def cell(q: Column) -> Column:
                    voted = total(r, lambda x: F.when(F.get(x["votes"], F.floor(q / 3).cast("int")) == q % 3 - 1, parts[c](x)).otherwise(0.0))
                    return (F.get(fixed[c], q) * n * ANCHOR + voted) / (mine + n * ANCHOR)

                return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell).alias(c)

            tables = [estimates(c) for c in parts]
            return F.struct(((total(r, parts["yes"]) + 0.2 * ANCHOR * n) / (n + ANCHOR * n)).alias("prior"), *tables)

        return F.element_at(F.transform(F.array(shared), update), 1)

    lists = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda model, _: step(model, F.col("pats")))
    return lists.select("kind", fitted.alias("model"))


@dataclass
class Model:
    """Plain numbers: EM's estimates by kind, and the classifier's weights."""

    labelers: dict[str, dict] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)

    def posterior(self, kind: Column, votes: Column) -> Column:
        known = F.from_json(F.lit(json.dumps(self.labelers)), "map<string,struct<prior:double,yes:array<double>,no:array<double>>>")
        return _posterior(F.element_at(known, kind), votes)

    def probability(self, x: Column) -> Column:
        """Of a candidate's features; one half where the model knows nothing of them."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        odds = F.aggregate(x["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.get(weights, f), F.lit(0.0)))
        return 1 / (1 + F.exp(-odds))


def fit(extracted: DataFrame, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """Estimate the labelers and train the classifier on all candidates of extracted, which is read twice.

    Candidates with the same features are one row with their number. A step's new weight is the old one
    and its gradient, divided by a bound of the curvature there: a quarter of a candidate's number of
    features for each candidate that has it, and the penalty (none on constants).
    """
    labelers = {r.kind: r.model.asDict() for r in reliabilities(vote_patterns(extracted), rounds).collect()}
    if not labelers:
        return Model()
    model = Model(labelers, [0.0] * (WEIGHTS * len(KINDS)))
    each = extracted.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    each = cut(each.select("features", "n", model.posterior(F.col("kind"), F.col("votes")).alias("yes")))
    totals = each.select(F.explode("features").alias("f"), "n", F.round(F.col("n") * F.col("yes") * MILLION).cast("long").alias("yes")).groupBy("f").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).collect()
    counts = {r.f: r.n for r in totals}
    for r in totals:
        if r.f % WEIGHTS == WEIGHTS - 1:
            # a kind's constant starts from its share of personal data
            model.weights[r.f] = log((r.yes + 1) / (r.n * MILLION - r.yes + 1))
    for _ in range(steps):
        off = F.round((F.col("yes") - model.probability({"features": F.col("features")})) * F.col("n") * MILLION).cast("long")
        gradient = each.select(F.explode("features").alias("f"), off.alias("off")).groupBy("f").agg(F.sum("off").alias("off")).collect()
        for r in gradient:
            penalty = 0.0 if r.f % WEIGHTS == WEIGHTS - 1 else PENALTY
            model.weights[r.f] += (r.off / MILLION - penalty * model.weights[r.f]) / (FEATURES * counts[r.f] / 4 + penalty)
    return model


def decide(extracted: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """(row, email, ip, card, phone, added): candidates that the classifier takes, as (kind, start, end, probability)."""
    scored = F.transform(F.filter("candidates", lambda x: ~x["is_base"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), model.probability(x).alias("probability")))
    return extracted.select("row", *BASE, F.filter(scored, lambda x: x["probability"] >= min_probability).alias("added"))


def all_spans(base_only: bool = False) -> Column:
    """Spans of a decided row as array<struct<rank, start, end, kind>>, by kind as listed, then start."""

    def ranked(column: str, rank, kind) -> Column:
        return F.transform(column, lambda x: F.struct(rank(x).cast("int").alias("rank"), x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind")))

    def fixed(value):
        return lambda x: F.lit(value)

    lists = [ranked(k, fixed(i), fixed(k)) for i, k in enumerate(BASE)]
    if not base_only:
        order = F.array(*[F.lit(k) for k in KINDS])
        lists.append(ranked("added", lambda x: F.array_position(order, x["kind"]) - 1, lambda x: x["kind"]))
    return F.array_sort(F.concat(*lists))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs. Texts are scanned once; spans and candidates are written."""
    with steps_to_one_table(docs.sparkSession):
        extracted = cut(extract(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"]))
    done = decide(extracted, fit(extracted))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return done.select("row.doc_id", *counts, F.sha2(listed(all_spans(True)), 256).alias("base_sha256"), listed(all_spans()).alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with each span of the text replaced by its kind in brackets: one narrow pass."""
    done = with_once(decide(extract(docs, text_col), model).withColumn("spans", all_spans()), spans=F.array_sort(F.transform(F.col("spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    text = F.col(f"row.`{text_col}`")

    def step(s: Column, x: Column) -> Column:
        fresh = F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        return F.when(x["start"] >= s["at"], fresh).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    columns = [F.col(f"row.`{c}`") if c != text_col else F.when(text.isNotNull(), clean).alias(c) for c in docs.columns]
    return done.select(*columns)

