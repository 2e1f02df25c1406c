"""Resampling, fill-in-middle and personal data against brute force, and on null, empty, tied, repeated and clashing rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from lettermill.llm import fim, personal, resample

SCHEMA = "doc_id bigint, text string, row string, score string, rank int, n int, spans string, added string, output string, form string"
WORDS = "the of And stone RIVER cloud élan 東京 x1 9 letter-paper it's".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, 2, "c", "d", "e", "f") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(0, 60))) for i in range(80)]
    return [*out, (7, out[7][1]), (7, out[7][1]), (None, out[9][1]), (None, out[9][1]), (500, None), (501, ""), (502, " \n\n "), (503, prose(rng, 30_000)), (504, "\n".join("line" for _ in range(20_000)))]


# ---------------------------------------------------------------- resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_plan(rows, target, s):
    def feats(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(1, s.max_n + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    c, t = [0] * s.buckets, [0] * s.buckets
    for counts, texts in ((c, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in feats(text):
                counts[bucket(f)] += 1
    b, big_s, big_t = s.buckets, sum(c), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (big_s + b) / ((c[i] + 1) * (big_t + b)))) for i in range(b)]
    out = []
    for i, text in rows:
        f = feats(text)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    fit = sorted((x for x in out if x[4] >= s.min_words), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(fit[: len(fit) * s.percent // 100])}
    return sorted([(*x[:4], rank.get(id(x))) for x in out], key=repr)


@pytest.mark.parametrize(("max_n", "percent", "piece"), [(1, 10, 1 << 23), (2, 50, 200), (4, 100, 1)])
def test_plan_equals_brute_force(spark, rows, monkeypatch, max_n, percent, piece):
    monkeypatch.setattr(resample, "PIECE_BYTES", piece)
    s = resample.Settings(max_n=max_n, buckets=97, percent=percent)
    target = ["the river and the stone", None, "", "東京 x1 x1 x1"]
    got = resample.plan(docs_of(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), settings=s).collect()
    assert sorted(map(tuple, got), key=repr) == brute_plan(rows, target, s)


def test_draw_keeps_columns_and_tables_may_be_empty(spark, rows):
    docs, target = docs_of(spark, rows), spark.createDataFrame([("stone river stone",)], "text string")
    drawn = resample.draw(docs, target, settings=resample.Settings(percent=30))
    ids = [r.doc_id for r in resample.plan(docs, target, settings=resample.Settings(percent=30)).where("rank is not null").collect()]
    assert drawn.columns == docs.columns and set(ids) == {r.doc_id for r in drawn.collect()} and drawn.count() >= len(ids)
    none = docs.limit(0)
    assert resample.plan(none, target).collect() == [] and resample.draw(none, target).collect() == []
    assert resample.plan(docs, target.limit(0)).count() == len(rows)


# ---------------------------------------------------------------- fill-in-middle


def brute_fim(doc_id, text, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < spm_percent else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(units), form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), sha(out), sha(text))


def test_cuts_equal_brute_force_and_texts_come_back(spark, rows):
    rng = random.Random(8)
    more = [(1000 + i, "".join(rng.choice("ab\n<>PSM\r 😀") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    more += [(2000, "one <P> two\nthree"), (2001, "a<\nb<S\nc<M"), (2002, "\n\n\n"), (2003, "x" * 50_000), (2004, "no end\nof line")]
    every = rows + more
    got = sorted(map(tuple, fim.digests(docs_of(spark, every)).collect()), key=repr)
    assert got == sorted((brute_fim(*r) for r in every), key=repr)


@pytest.mark.parametrize("unit", ["line", "word", "character"])
def test_other_units_shares_and_sentinels(spark, rows, unit):
    marks = fim.Sentinels("{pre", "[suf", "(mid")
    done = fim.transform(docs_of(spark, rows), unit=unit, percent=60, spm_percent=20, marks=marks)
    again = done.select("row.text", "form", fim.restore(F.col("output"), F.col("form"), marks).alias("back"), "n").collect()
    assert all(r.back == (r.text or "") for r in again) and {r.form for r in again} == {"plain", "psm", "spm"}
    assert done.select("row.*").columns == docs_of(spark, rows).columns
    with pytest.raises(ValueError):
        fim.Sentinels("<A", "<A>", "<B>")


def test_unit_ends_tile_the_text():
    assert fim.unit_ends("", fim.UNITS["line"]) == [] and fim.unit_ends("a\n\nb", fim.UNITS["line"]) == [2, 3, 4]
    assert fim.unit_ends("ab", "a") is None
    assert fim.transform.__defaults__[2] == "line"


# ---------------------------------------------------------------- personal data

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_base(text):
    out = {}
    for kind, pattern in _PLAIN.items():
        found = [(m.start(), m.end(), re.sub("[^0-9]", "", m[0]), m[0]) for m in re.finditer(pattern, text or "")]
        ok = {"email": lambda d, v: True, "ip": lambda d, v: all(int(x) <= 255 for x in v.split(".")), "card": lambda d, v: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d, v: 9 <= len(d) <= 15}[kind]
        out[kind] = [(a, b) for a, b, d, v in found if ok(d, v)]
    return out


def digest(base):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in base for a, b in base[k]).encode()).hexdigest()


def random_texts(rng):
    for _ in range(400):
        yield "".join(rng.choice("0123456789 -.+()@ab%_é😀\n\u0001") for _ in range(rng.randint(0, 80)))
    for _ in range(100):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(11, 19)))
        yield f"{rng.choice('a1 .')}{digits}{next(c for c in '0123456789' if luhn(digits + c))}{rng.choice(' -x.5')}"
    yield from ["a" * 3000 + "@", "1" * 3000 + ".", "a@" + "b." * 50_000 + "c", "+1" + " " * 100_000, "1 " * 50_000, "a@b.c@d.e_x@f.g", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 00000000000000000001.2.3.4", "x@y.z" * 3000]


def test_base_spans_equal_brute_force(spark, rows):
    texts = [*random_texts(random.Random(11)), None, "", *[t for _, t in rows]]
    docs = docs_of(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in personal.find(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = brute_base(text)
        assert [got[i][f"n_{k}"] for k in base] == [len(base[k]) for k in base] and got[i].base_sha256 == digest(base), repr(text)
        spans = got[i].spans.split(",") if got[i].spans else []
        assert {f"{k}:{a}:{b}" for k in base for a, b in base[k]} <= set(spans)
        order = [(personal.KINDS.index(k), int(a)) for k, a, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000 + "@", "1" * 200_000 + ".", "Ab" * 100_000 + " Cd", "1-" * 100_000, "x at " * 40_000 + " dot ", "+" * 200_000, "A1" * 100_000]
    got = personal.find(docs_of(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts) and not any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)


GOOD = {
    "name": ["My name is {Ann} Miller and", "Contact: {Ann} Fischer, office", "Dear Mr. {Ann} Novak, thanks"],
    "phone": ["call me at (555) 234-1{3} today", "Phone: 0171 555 1{3}.", "my mobile is 0151 234 5{3} now"],
    "id": ["SSN: 123-45-6{3}.", "my social security number is 321-54-7{3} here"],
    "birth": ["she was born on 12.03.1984 in town", "date of birth: 1979-11-05."],
    "email": ["write to jane.doe at example dot com please", "mail: bob (at) mail3 (dot) org soon"],
    "address": ["I live at 12 Maple Street in town", "Adresse: Lindenstraße 14, bitte", "j'habite 5 rue de Provence ici"],
    "iban": ["my account is DE89370400440532013000 here", "IBAN: GB82 WEST 1234 5698 7654 32 please"],
    "card": ["card number 4111 1111 1111 1112 visa"],
}
BAD = [
    "version 12.03.1984 of it",
    "the order 555-234-9{3} was sent",
    "invoice 321-54-7{3} was paid",
    "see Chapter Seven there",
    "in New York Times today",
    "ISBN 978-3-16-148410-0 of it",
    "United States Government says",
    "code AB12CDEF1234XYZ9 of it",
    "Reinheon Ereda and Onanhe",
    "price 555.234.1{3} total",
]


def test_labelers_and_classifier_find_planted_spans_and_spare_the_rest(spark):
    rng = random.Random(2)
    names = personal.GIVEN_NAMES.split()

    def fill(x):
        return x.replace("{Ann}", rng.choice(names)).replace("{3}", f"{rng.randint(0, 999):03}")

    cases = []
    for i in range(900):
        good = i % 3 == 0
        kind = rng.choice(list(GOOD)) if good else None
        cases.append((i, f"{prose(rng, 12).lower()} {fill(rng.choice(GOOD[kind] if good else BAD))} {prose(rng, 6).lower()}", kind))
    found = {r.doc_id: r.spans for r in personal.find(docs_of(spark, [c[:2] for c in cases])).collect()}
    hit = [c for c in cases if c[2] and any(x.startswith(c[2] + ":") for x in found[c[0]].split(","))]
    wrong = [(c[1], found[c[0]]) for c in cases if not c[2] and found[c[0]]]
    assert len(hit) >= 0.95 * sum(c[2] is not None for c in cases), [c for c in cases if c[2] and c not in hit][:10]
    assert not wrong, wrong[:10]
    repeat = {r.doc_id: r.spans for r in personal.find(docs_of(spark, [c[:2] for c in reversed(cases)])).collect()}
    assert repeat == found


def test_numbers_that_run_into_others_are_found_by_the_method(spark):
    """A phone or card beside other digits, which the base patterns drop, is told from the corpus's other phones and cards."""
    rng = random.Random(13)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return d + next(c for c in "0123456789" if luhn(d + c))

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04}"
    rows = [(i, f"{prose(rng, 8)} {phone()} river, {card()} {prose(rng, 8)}") for i in range(150)]
    rows += [(1000 + i, f"the {phone()} {card()} of") for i in range(12)] + [(2000 + i, f"the 27.204.213.132 {card()} {card()} of") for i in range(12)]
    rows += [(3000 + i, f"the {rng.randint(10**15, 10**16 - 1)} of") for i in range(60)]
    got = {r.doc_id: r for r in personal.find(docs_of(spark, rows)).collect()}
    for i, text in rows:
        kinds = [x.split(":")[0] for x in got[i].spans.split(",") if x]
        if 1000 <= i < 2000:
            assert (got[i].n_phone, got[i].n_card) == (0, 0) and kinds == ["card", "phone"], (text, got[i].spans)
        elif 2000 <= i < 3000:
            assert kinds == ["ip", "card", "card"], (text, got[i].spans)
        elif i >= 3000 and not got[i].n_card:
            assert not kinds, (text, got[i].spans)


def brute_em(patterns, rounds):
    """The same estimates for one kind in plain Python: patterns is {votes: n}."""
    start = {True: [a for a, _ in personal.ASSUMED.values()], False: [b for _, b in personal.ASSUMED.values()]}
    n, k = sum(patterns.values()), len(personal.LABELERS)
    prior, p = 0.2, {y: [list(x) for x in start[y]] for y in start}
    for _ in range(rounds):
        r = {}
        for v in patterns:
            yes = prior * math.prod(p[True][j][c + 1] for j, c in enumerate(v))
            no = (1 - prior) * math.prod(p[False][j][c + 1] for j, c in enumerate(v))
            r[v] = yes / (yes + no)
        new = {}
        for y in start:
            part = {v: m * (r[v] if y else 1 - r[v]) for v, m in patterns.items()}
            a = n * personal.ANCHOR
            new[y] = [[(start[y][j][c] * a + sum(m for v, m in part.items() if v[j] == c - 1)) / (sum(part.values()) + a) for c in range(3)] for j in range(k)]
        prior, p = (sum(m * r[v] for v, m in patterns.items()) + 0.2 * personal.ANCHOR * n) / (n + personal.ANCHOR * n), new
    return prior, p


def test_expectation_maximisation_equals_brute_force(spark):
    rng = random.Random(4)
    counts = {kind: {tuple(rng.choice((-1, 0, 1)) for _ in personal.LABELERS): rng.randint(1, 900) for _ in range(40)} for kind in ("name", "card")}
    table = spark.createDataFrame([(k, list(v), n) for k, c in counts.items() for v, n in c.items()], "kind string, votes array<int>, n bigint")
    for r in personal.reliabilities(table, rounds=12).collect():
        prior, p = brute_em(counts[r.kind], 12)
        assert r.model.prior == pytest.approx(prior, rel=1e-9)
        assert r.model.yes == pytest.approx([x for row in p[True] for x in row], rel=1e-9) and r.model.no == pytest.approx([x for row in p[False] for x in row], rel=1e-9)
    assert personal.reliabilities(table.limit(0)).count() == 0


def test_redaction_replaces_spans_and_leaves_the_rest(spark):
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 5)} my social security number is 321-54-7{i:03} and mail a{i}@b.org.") for i in range(100)] + [(None, None), (5, ""), (6, "é😀 nothing here")]
    docs = docs_of(spark, rows)
    out = personal.redact(docs, personal.fit(personal.extract(docs)))
    got = {r.doc_id: r.text for r in out.where("doc_id >= 10 or doc_id is null").collect()}
    assert out.columns == docs.columns and got[None] is None
    assert all(got[i] == regex.sub(r"a\d+@b\.org", "[EMAIL]", regex.sub(r"321-54-7\d{3}", "[ID]", rows[i][1])) for i in range(10, 100)), got[10]
    assert sorted(r.text for r in out.where("doc_id in (5, 6)").collect())[0] == ""


def test_no_rows_and_no_candidates(spark):
    none = docs_of(spark, [(1, "x")]).limit(0)
    assert personal.find(none).collect() == [] and fim.digests(none).collect() == []
    r = personal.find(docs_of(spark, [(1, "nothing at all"), (None, None)])).collect()
    assert {(x.doc_id, x.spans, x.base_sha256) for x in r} == {(1, "", hashlib.sha256(b"").hexdigest()), (None, "", hashlib.sha256(b"").hexdigest())}
    plan = personal.find(docs_of(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
