"""Each operator against brute force on small tables, and on null, empty, tied, repeated and clashing rows."""

import hashlib
import html
import io
import random
import re
import wave
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lettermill.llm import decontam, htmlmain, langid, licenses, linededup, media, mixing, sharding, simhash, urlfilter
from lettermill.llm.queries import ORACLES, QUERIES
from tests.oracle import differences, run_sql

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size string, shard string, _slot int"
WORDS = "the of and stone river cloud letter paper green seven winter road light house field north water iron glass bread".split()


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 7) for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    base = prose(rng, 80)
    long = prose(rng, 30_000)
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.upper(), None, None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n", "de", None),
        (7, long, "de", "c"),
        (8, long + " tail", "de", "c"),
        (None, base, "en", "a"),
        (9, "Straße élan ﬁn 東京", "de", "c"),
    ]


def xxh_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def component_of(ids_fps):
    parent = list(range(len(ids_fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(ids_fps):
        for j in range(i):
            if (a ^ ids_fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(ids_fps):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(ids_fps))]


def test_simhash_components_equal_brute_force(spark, odd_rows):
    rng = random.Random(1)
    rows = list(odd_rows)
    for i in range(60):
        words = prose(rng, 300).split()
        rows.append((100 + 3 * i, " ".join(words), "en", "a"))
        for k in (1, 2):
            words[rng.randrange(len(words))] = "changed"
            rows.append((100 + 3 * i + k, " ".join(words), "en", "a"))
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = [(r[0], xxh_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f, c) for (d, f), c in zip(fps, component_of(fps), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == want
    assert len({c for _, _, c in want}) < len(want) - 30


@pytest.mark.parametrize("cuts", [simhash.HALVES, simhash.TRIPLES])
def test_simhash_links_miss_nothing(spark, cuts):
    rng = random.Random(5)
    fps = set()
    for _ in range(200):
        x = rng.getrandbits(64)
        fps.add(x)
        for n in range(1, 6):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), cuts).collect()}
    order = sorted(fps, key=lambda f: f - (1 << 64) if f >> 63 else f)
    assert got == {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_simhash_recall_on_all_documents(spark):
    """On the whole of a generated table, the links and components are those of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [(d, xxh_fingerprint(t)) for d, t in texts.items()]
    assert got == {d: (f, c) for (d, f), c in zip(fps, component_of(fps), strict=True)}
    assert len({c for _, c in got.values()}) < len(got)


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + hub, "a bigint, b bigint")).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1000 + i] == 1000 for i in range(1, 300))


def test_keep_one_keeps_one_of_each_group(spark, odd_rows):
    kept = simhash.keep_one(docs_of(spark, odd_rows)).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == [1, 4, 7, 9] or ids == [1, 4, 7, 8, 9]
    assert kept[0].asDict().keys() == docs_of(spark, odd_rows).first().asDict().keys()


def brute_words(text):
    """Words of a text, character by character: those of scripts without blanks stand alone."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        alone = any(int(a, 16) <= ord(c) <= int(b, 16) for a, b in decontam.UNSPACED)
        if (c.isalnum() or c == "_") and not alone:
            word += c
            continue
        out += [word] * bool(word) + [c] * (alone and c.isalnum())
        word = ""
    return out


def brute_overlap(doc, item):
    t, b = brute_words(doc), brute_words(item)
    if len(b) < decontam.MIN_WORDS:
        return bool(b) and t == b
    n = min(len(b), decontam.WINDOW)
    allowed = n * decontam.MAX_SUBSTITUTIONS // decontam.WINDOW
    return any(sum(x != y for x, y in zip(t[i : i + n], b[j : j + n], strict=True)) <= allowed for i in range(len(t) - n + 1) for j in range(len(b) - n + 1))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    many = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(many) for _ in range(n))
    items = [(i, text(rng.choice([3, 6, 7, 9, 12, 13, 14, 30]))) for i in range(40)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs = [(None, None), (1, None), (2, ""), (3, "w1 w2"), (4, "W1, w2!"), (5, "w1 w2 w1 w2")]
    for i in range(200):
        words = text(rng.randrange(5, 80)).split()
        if i % 2:
            passage = rng.choice(items[:40])[1].split()
            for _ in range(rng.randrange(5)):
                passage[rng.randrange(len(passage))] = "xx"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((10 + i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    frame = docs_of(spark, [(*d, None, None) for d in docs])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(frame, bench).collect()}
    want = {(d, i) for d, t in docs for i, b in items if brute_overlap(t, b)}
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in decontam.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_every_pair_of_places_is_ignored_by_a_mask():
    for a in range(decontam.WINDOW):
        for b in range(decontam.WINDOW):
            assert any(all(a not in decontam.runs()[i] and b not in decontam.runs()[i] for i in m) for m in decontam.masks())
    for span in range(1, decontam.WINDOW):
        assert sorted(o for run in decontam.runs(span) for o in run) == list(range(span)) and decontam.substitutions(span) == (span >= 7)
        for a in range(span if decontam.substitutions(span) else 0):
            assert any(all(a not in decontam.runs(span)[i] for i in m) for m in decontam.masks(span))


def test_decontamination_of_scripts_without_blanks_and_of_shared_ids(spark):
    item = "今日は天気がいいから散歩しましょうと彼は言いましたそして出かけた"
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(1, f"前の文{item}後の文"), (2, "今日は天気が悪いので家で本を読みました"), (3, "abc" + item.replace("散", "走") + "x"), (None, passage), (None, f"{passage} more"), (None, "other words"), (7, passage), (7, f"z {passage}"), (7, f"z {passage}"), (8, "free")]
    bench = spark.createDataFrame([(1, item), (2, passage)], "item_id bigint, text string")
    frame = docs_of(spark, [(*d, None, None) for d in docs])
    got = sorted(((r.doc_id, r.item_id, r.n_windows, r.first_word) for r in decontam.overlaps(frame, bench).collect()), key=repr)
    texts = {(d, t) for d, t in docs}
    assert sorted(((d, i) for d, i, *_ in got), key=repr) == sorted(((d, i) for d, t in texts for i, b in ((1, item), (2, passage)) if brute_overlap(t, b)), key=repr)
    assert sorted(g[2:] for g in got if g[0] == 7) == [(2, 0), (2, 1)] and [g for g in got if g[0] is None] == [(None, 2, 2, 0)] * 2
    assert sorted({r.doc_id for r in decontam.clean(frame, bench).collect()}, key=repr) == [2, 8, None]
    large = spark.createDataFrame([((1 << 60) + 1, passage), (None, passage)], "doc_id bigint, text string")
    assert {r.doc_id for r in decontam.overlaps(large, bench).collect()} == {(1 << 60) + 1, None}
    named = spark.createDataFrame([("a:1", passage)], "doc_id string, text string")
    assert decontam.overlaps(named, bench).first().doc_id == "a:1"


def test_decontamination_salted_join_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "SALT_ROWS", 1)
    monkeypatch.setattr(decontam, "FLUSH", 3)
    monkeypatch.setattr(decontam, "CHUNK", 64)
    monkeypatch.setattr(decontam, "MIN_FILTER_BITS", 1 << 15)
    monkeypatch.setattr(decontam, "BITS_PER_HASH", 1)
    item = " ".join(f"k{i}" for i in range(20))
    text = " ".join(f"z{i % 97}" for i in range(55)) + " " + item + " " + " ".join(f"z{i % 89}" for i in range(500))
    found = decontam.overlaps(docs_of(spark, [(1, text, None, None), (2, text.replace("k", "q"), None, None)]), spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word <= 55, r.last_word >= 74, r.most_equal) for r in found] == [(1, 5, True, True, 13)]


def test_decontamination_finds_items_at_every_place_past_a_chunk(monkeypatch):
    """The last windows of a text of every length are hashed, those of short items, too."""
    monkeypatch.setattr(decontam, "CHUNK", 40)
    for span in (5, 6, 12, 13):
        item = [f"k{i}" for i in range(span)]
        for rest in range(1, 54):
            text = " ".join([f"z{i}" for i in range(40 + rest - span)] + item) if 40 + rest >= span else ""
            keys = {k for _, ks in decontam._hits(decontam.word_hashes(" ".join(item)), span, decontam._Filter(None)) for k in ks.tolist()}
            import pandas as pd

            rows = pd.concat(list(decontam._windows([span], type("Held", (), {"value": None}))(iter([pd.DataFrame({"id": ["1"], "text_key": [1], "text": [text]})]))))
            starts = {(p, k) for p, k in zip(rows["pos"], rows["key"].to_numpy().view(np.uint64).tolist(), strict=True)}
            assert {(40 + rest - span, k) for k in keys} <= starts
            assert len(rows) == (40 + rest - span + 1) * max(1, len(decontam.masks(span)))


def brute_lines(rows, min_words):
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, _signed(r[1])))
    first, gone = {}, defaultdict(set)
    runs = []
    for k, (_, text) in enumerate(docs):
        lines = text.split("\n")
        n = [len(x.encode().split()) for x in lines]
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(n[s : e + 1]) >= min_words:
                    run = tuple(lines[s : e + 1])
                    runs.append((k, s, e, run))
                    first[run] = min(first.get(run, (k, s)), (k, s))
    for k, s, e, run in runs:
        if first[run] != (k, s):
            gone[docs[k]] |= set(range(s, e + 1))
    return sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in rows), key=repr)


def _signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([0, 1, 1, 2, 3, 5, 8])) for _ in range(9)]
    rows = [(i if i % 7 else None, "\n".join(rng.choice(pool) if rng.random() < 0.93 else prose(rng, 6) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    rows += [(50, None), (51, ""), (51, ""), (52, "a a a\n" * 40), (3, rows[3][1])]
    got = linededup.dedup_lines(docs_of(spark, [(*r, None, None) for r in rows]), min_words=10).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_lines(rows, 10)


def test_line_dedup_of_very_long_texts_and_odd_rows(spark, odd_rows):
    """A text of thousands of lines that repeats itself and another's lines; nulls, blanks and repeated rows."""
    rng = random.Random(14)
    lines = [prose(rng, 12) for _ in range(3000)]
    short = ["a b", "c"]
    long = "\n".join(lines + short + lines[1000:1500] + ["own line at the end of the long text here it is now"])
    other = "\n".join(["first own line"] + lines[100:160] + short)
    rows = [(1, long), (2, other), (2, other), (3, None), (4, "")] + [(100 + i if r[0] is not None else None, r[1]) for i, r in enumerate(odd_rows)]
    got = defaultdict(list)
    for r in linededup.dedup_lines(docs_of(spark, [(*r, None, None) for r in rows])).collect():
        got[r.doc_id].append((r.n_lines, r.n_removed, r.text))
    assert got[1] == [(3503, 500, "\n".join(lines + short + ["own line at the end of the long text here it is now"]))]
    assert got[2] == [(63, 60, "\n".join(["first own line", *short]))] * 2
    assert got[3] == [(0, 0, None)] and got[4] == [(1, 0, "")] and sum(map(len, got.values())) == len(rows)


def test_mixing_targets_and_takes(spark, odd_rows):
    rng = random.Random(4)
    rows = odd_rows + [(100 + i, prose(rng, rng.randrange(1, 60)), "en", "big" if i % 3 else f"s{i % 5}") for i in range(300)]
    got = mixing.plan(docs_of(spark, rows)).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:  # reshare the excess by weight until none is above
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / free > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = None if r.src == "1" else r.src[1:]
        taken[s] += r.taken
        target[s] = r.target
    assert len(got) == len(rows)
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.plan(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_repeats_and_cuts_whole_rows(spark):
    rows = [(i, f"w{i} a b c", "en", "s0" if i < 20 else "s1") for i in range(120)]
    plan = {r.doc_id: r for r in mixing.plan(docs_of(spark, rows)).collect()}
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert all(times[i] == -(-plan[i].taken // plan[i].size) for i in plan)


def test_mix_and_slots_where_many_rows_share_an_id(spark, monkeypatch):
    """The mix meets its plan under a null id, a hot id and wholly equal rows; no range holds a hot id."""
    from lettermill.functions import ranks

    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 20)
    rows = [(None, f"w{i} a b c", "en", "s0") for i in range(100)] + [(7, f"v{i} a b c", "en", "s1") for i in range(100)]
    rows += [(9, "same text here", "en", "s2")] * 150 + [(i, f"u{i} a b c", "en", "s2") for i in range(100, 130)]
    docs = docs_of(spark, rows)
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.plan(docs).collect():
        want[r.src[1:]] += -(-r.taken // r.size)
    for r in mixing.mix(docs).collect():
        got[r.source] += 1
    assert got == want
    largest = []
    real = ranks.cut
    monkeypatch.setattr(ranks, "cut", lambda df: (lambda t: (largest.append(max((r["count"] for r in t.groupBy("range").count().collect()), default=0)) if "range" in t.columns else None, t)[1])(real(df)))
    slots = defaultdict(list)
    for r in sharding.assign(docs.repartition(4)).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(largest) <= 60


def test_sharding_law_slots_and_weights(spark, odd_rows):
    rows = odd_rows + [(1000 + i, f"t{i}", "en", "a") for i in range(2000)]
    got = sharding.assign(docs_of(spark, rows), keep_columns=True).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    by_id = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add(r.shard)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in by_id.values())
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert 0.07 < moved < 0.16
    from pyspark.sql import functions as F

    shares = {r.s: r["count"] for r in spark.range(6000).select(sharding.shard_of(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()}
    assert set(shares) == {0, 1} and 0.7 < shares[1] / 6000 < 0.8


RULE_CASES = [
    (1, "https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://EXAMPLE.net/de/1?q=/en/", "example.net", "/de/1", "net/", "block"),
    (3, "http://a.example.com/de/", "a.example.com", "/de/", "example.com/de/", "block"),
    (4, "http://x.org/fr/9#a", "x.org", "/fr/9", "org/fr/", "allow"),
    (5, "http://x.org", "x.org", "", None, "allow"),
    (6, None, "", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, "http://www.spam-farm.example.org?x=http://y.net/", "www.spam-farm.example.org", "", None, "block"),
    (9, "http://notspam-farm.example.org/", "notspam-farm.example.org", "/", None, "allow"),
    (10, "http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
    (10, "http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
]


def test_url_rules_and_list(spark):
    pages = spark.createDataFrame([(r[0], r[1], "h", "v") for r in RULE_CASES], "page_id bigint, url string, host string, verdict string")
    blocked = spark.createDataFrame([("spam-farm.example.org",), (None,), ("unused.example.org",)], "key string")
    got = urlfilter.judge(pages, blocked).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *r[2:]) for r in RULE_CASES), key=repr)


def test_cascade_is_exact_in_several_passes(spark):
    hosts = [f"h{i}.example.org" for i in range(3000)]
    listed = set(hosts[::3])
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id bigint, url string")
    blocked = spark.createDataFrame([(h,) for h in listed], "key string")
    for per_pass in (10_000, 400):
        got = urlfilter.judge(pages, blocked, rules=(), keys_per_pass=per_pass).collect()
        assert {r.host for r in got if r.verdict == "block"} == listed and len(got) == len(hosts)


def test_cascade_has_several_levels_that_do_not_grow_with_the_corpus(spark):
    """Few listed keys among ever more others: the first level lets few others through."""
    from pyspark.sql import functions as F

    for others in (2_000, 40_000):
        keys = spark.range(others + 60).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") < 60).alias("listed"))
        cascade = urlfilter.Cascade(keys)
        assert len(cascade.levels) >= 3 and cascade.levels[1].bits <= 60 * 8 and sum(level.bits for level in cascade.levels) < 60 * 64
        assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


def test_html_extraction(spark):
    page = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></ul></nav><div class="ad">buy</div><article><h1>T &amp;\n U</h1><p>a<b>b</b> c<br>d<p>e&nbsp;&#233;&am<!-- x --><script>1</script><div class="comments"><p>rant</p></div></article><footer>&copy;</footer>'
    cases = {1: (page, "T & U\nab c d\ne é&am"), 2: (None, ""), 3: ("", ""), 4: ("<nav>only</nav>", ""), 5: ("plain < text", "plain < text"), 6: ("<p>cut <b", "cut"), 7: ("<p>" + "x " * 50_000, ("x " * 50_000).strip())}
    rows = [(i, f"http://h{i}.org/", h, "c") for i, (h, _) in cases.items()] + [(8, None, page, "c")]
    got = {r.page_id: (r.text, r.n_chars) for r in htmlmain.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    want = {i: t for i, (_, t) in cases.items()} | {8: cases[1][1]}
    assert got == {i: (t, len(t)) for i, t in want.items()}


LAYOUTS = [
    ('<div class="page has-sidebar"><article><p>Hello</p></article><div class="sidebar">side</div></div>', "Hello"),
    ('<article class="post has-comments"><p>Hello</p><div id="comments"><p>rant</p></div></article>', "Hello"),
    ('<div id="content-with-rail"><p>Hello</p></div>', "Hello"),
    ('<div class="sidebar-wrap"><main><p>Hello</p></main><div class="sidebar-left">x</div></div>', "Hello"),
    ("<div id=body><p>" + "The body of the page. " * 9 + "</p></div><article><h3>Teaser</h3></article>", ("The body of the page. " * 9).strip()),
    ('<article><section id="discussion"><h2 id="related-work">Related work</h2><p id="notice-period">Kept</p></section><p class="notice">gone</p></article>', "Related work\nKept"),
    ('<div class="Sidebar"><p>' + "Most of the text. " * 5 + "</p></div><p>tail</p>", ("Most of the text. " * 5).strip() + "\ntail"),
    ('<article><p>A</p></article><ol class="comment-list"><li><article class="comment-body"><p>' + "reader " * 50 + "</p></article></li></ol>", "A"),
    ('<article><header><h1>T</h1></header><p data-id="ad">x</p><div class="ad-banner">buy</div><footer>by me</footer></article>', "T\nx"),
    # reader comments inside articles
    ('<article><p>Body</p><section class="comments"><p>c1</p></section></article>', "Body"),
    ('<article><p>Body</p><section id="comments"><h2>Comments</h2><p>c1</p></section><section id="discussion"><p>Kept</p></section></article>', "Body\nKept"),
    ('<article><p>Body</p><div class="user-comments"><p>c1</p></div><div class="reader-comments"><p>c2</p></div></article>', "Body"),
    ('<div class="layout comments-open"><p>Body</p><div id="fb-comments-2"><p>c1</p></div></div>', "Body"),
    ('<article><p>Body</p><pre><span class="comment"># said</span> <span class="ad">x</span></pre></article>', "Body\n# said x"),
    # pages in a form, in a notice, in a name
    ('<form id="aspnetForm"><div><p>Whole page text</p></div><label>Search</label><select><option>x</option></select></form>', "Whole page text"),
    ('<form id="aspnetForm"><nav>menu</nav><main><p>Whole page text</p></main></form>', "Whole page text"),
    ('<p>The text of a page that has a form below it.</p><form><label>Name</label><p>Short words</p></form>', "The text of a page that has a form below it."),
    ("<form><label>Name</label><input></form>", ""),
    ('<div class="notice"><p>The whole thing is a notice</p></div>', "The whole thing is a notice"),
    ('<div class="modal"><p>' + "Most of it. " * 9 + "</p></div><p>tail</p>", ("Most of it. " * 9).strip() + "\ntail"),
    ('<div class="cookie-consent"><p>' + "We use cookies. " * 9 + "</p></div><p>tail</p>", "tail"),
    ('<div class="ad"><p>only adverts</p></div>', ""),
    # articles beside longer texts
    ('<article><h1>T</h1><p>A short one.</p></article><div><p>' + "I think so, too. " * 40 + "</p></div>", "T\nA short one."),
    ('<article><p>A short one.</p></article><div><p>' + "I think so, too. " * 40 + "</p></div>", "A short one."),
    ('<div><p>' + "The story itself. " * 40 + '</p></div><article><a href="/x"><p>Read this, too</p></a></article>', ("The story itself. " * 40).strip()),
    ('<div><h1>T</h1><p>' + "The story itself. " * 40 + "</p></div><article><p>More a</p></article><article><p>More b</p></article>", "T\n" + ("The story itself. " * 40).strip()),
    # names of adverts
    ('<article><p>Body</p><div class="ad-slot">buy</div><div id="gdpr-bar">ok?</div><ins class="adsbygoogle">buy</ins><div class="top-ad">buy</div><div class="google-ads">buy</div></article>', "Body"),
    ('<div class="has-ads"><p>Body</p></div><div id="ad-300x250">buy</div>', "Body"),
    ('<div class="loading-readme"><p>Body</p><div class="download header-shadow">Get it</div></div>', "Body\nGet it"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end", "deep\nend"),
]


@pytest.mark.parametrize("n", range(len(LAYOUTS)))
def test_html_layouts(n):
    page, want = LAYOUTS[n]
    assert htmlmain.main_text(page) == want


def test_site_style_tree_removes_what_the_pages_of_a_host_share(spark, monkeypatch):
    body = lambda i: f"<div class=top><p>Shared line</p></div><div class=body><p>Own text {i}</p><p>More {i * i}</p></div>"
    rows = [(i, f"http://site.org/{i}", body(i)) for i in range(30)] + [(99, "http://lone.org/", body(7)), (98, "http://site.org/7", body(7)), (98, "http://site.org/7", body(7))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in htmlmain.extract(pages).collect()}
    assert all(got[i] == f"Own text {i}\nMore {i * i}" for i in range(30)) and got[98] == got[7]
    assert got[99] == "Shared line\nOwn text 7\nMore 49"
    monkeypatch.setattr(htmlmain, "BROADCAST_NODES", 0)
    assert {r.page_id: r.text for r in htmlmain.extract(pages).collect()} == got


def brute_tree(pages):
    """Importance, composite and branch of every node of each host, by dictionaries."""
    import math

    out = {}
    for host in {h for h, _ in pages}:
        rows = {(p, *r) for p in {p for h, p in pages if h == host} for r in htmlmain.tree_rows(p)}
        m, values = defaultdict(set), defaultdict(lambda: defaultdict(set))
        for page, ids, _, kind, value in rows:
            m[ids].add(page)
            values[ids, kind][value].add(page)
        own = {}
        for ids, on in m.items():
            scale = math.log(len(on) + htmlmain.PRIOR_PAGES)
            layout = 1 - sum(len(x) * math.log(len(x)) for x in values[ids, 0].values()) / len(on) / scale
            texts = values.get((ids, 1), {})
            content = 1 - sum(math.log(len(x)) for x in texts.values()) / len(texts) / scale if texts else None
            own[ids] = layout if content is None else (content + layout) / 2 if any(values[ids, 0].keys() - {0}) else content
        composite = {}
        for top in own:
            below = [i for i in own if i[: len(top)] == top]
            weight = {i: len(m[i]) * htmlmain.FADE ** (len(i) - len(top)) for i in below}
            composite[top] = sum(weight[i] * own[i] for i in below) / sum(weight.values())
        for top in own:
            out[host, top] = (own[top], composite[top], max(composite[i] for i in own if i[: len(top)] == top))
    return out


def test_style_tree_equals_brute_force(spark):
    rng = random.Random(12)
    part = lambda i: f"<div class='c{i % 3}'><p>{rng.choice(['same', prose(rng, 4)])}</p><ul><li>{rng.choice('ab')}<li><b>x</b></ul></div>"
    pages = [(f"h{i % 3}.org", f"<body><div class=nav{i}><p>Menu</p></div>" + "".join(part(i + j) for j in range(rng.randrange(4))) + "<p>foot") for i in range(40)]
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {(r.host, tuple(r.ids)): (r.importance, r.composite, r.branch) for r in htmlmain.style_tree(frame).collect()}
    want = brute_tree(pages)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(v[2] < htmlmain.MIN_IMPORTANCE for v in want.values()) and any(v[2] > 0.5 for v in want.values())


def test_media_round_trip(spark, odd_rows):
    docs = docs_of(spark, [*odd_rows, (20, "x" * 576, None, None), (21, "x" * 577, None, None)])
    got = media.media_columns(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        with wave.open(io.BytesIO(r.media)) as w:
            assert w.getsampwidth() == 1
            back = w.readframes(w.getnframes())
        assert back[: len(data)] == data and set(back[len(data) :]) <= {255} and len(back) % 576 == 0 and 0 <= len(back) - len(data) <= 576
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(data), len(back), zlib.crc32(back[-32:]), len(r.media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(back).hexdigest(), hashlib.sha256(r.media).hexdigest())
        assert [(p.time, p.code) for p in r.pairs] == sorted((p.time, p.code) for p in r.pairs)
    pairs = {r.doc_id: [p.time << media.TIME_SHIFT | p.code for p in r.pairs] for r in got}
    found = media.media_digests(docs).collect()
    assert all(r.pairs == pairs[r.doc_id] for r in found)
    digests = {r.doc_id: r.feature for r in found}
    assert digests[1] == digests[2] != digests[3] and digests[4] == digests[5]


def plain_peaks(samples):
    """Peaks by the transform's definition, a frame and a bin at a time."""
    import cmath
    import math

    count = 1 + -(-(len(samples) - media.WINDOW) // media.HOP)
    samples = [x - 127.5 for x in samples] + [0.0] * ((count - 1) * media.HOP + media.WINDOW - len(samples))
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (media.WINDOW + 1)) for i in range(media.WINDOW)]
    out = []
    for f in range(count):
        frame = [x * h for x, h in zip(samples[f * media.HOP : f * media.HOP + media.WINDOW], hann, strict=True)]
        power = [round(abs(sum(x * cmath.exp(-2j * math.pi * k * i / media.WINDOW) for i, x in enumerate(frame))), 3) for k in range(media.WINDOW // 2 + 1)]
        mean = sum(power[1:]) / (len(power) - 1)
        out.append([max(range(lo, hi), key=lambda k: (power[k], -k)) if max(power[lo:hi]) > mean else 0 for lo, hi in zip(media.BANDS, media.BANDS[1:], strict=False)])
    return out


def test_media_transform_equals_its_definition():
    for text in ("some words of a text " * 27, "é" * 300, ""):
        samples = np.frombuffer(media.payload(text), dtype=np.uint8)
        got, want = media._peaks(samples.astype(np.float32)), np.array(plain_peaks(samples.tolist()))
        # equal strengths to a thousandth may fall to either bin
        assert got.shape == want.shape and (got != want).mean() <= 0.01


def test_media_every_byte_reaches_a_frame():
    data = np.frombuffer(media.payload("a text of some words, " * 70), dtype=np.uint8)
    spectrum = lambda x: media._frames(x.astype(np.float32), 0, 1 + -(-(len(x) - media.WINDOW) // media.HOP))
    whole = spectrum(data)
    for at in (0, 1, 255, 256, 575, len(data) // 2, len(data) - 128, len(data) - 2, len(data) - 1):
        changed = data.copy()
        changed[at] ^= 255
        assert (spectrum(changed) != whole).any(), at


def test_media_peaks_follow_the_signal():
    rate = np.arange(4096)
    tone = (127.5 + 100 * np.sin(2 * np.pi * 20 * rate / media.WINDOW)).round().astype(np.uint8)
    assert set(media._peaks(tone.astype(np.float32))[:, 1]) == {20}


def test_media_pieces_do_not_change_features(monkeypatch):
    data = media.payload("some words " * 2000)
    whole = media.fingerprint(data)
    monkeypatch.setattr(media, "FRAMES", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(data), strict=True))


def test_media_features_see_the_tail_and_all_bands():
    data = b"some words of a text " * 300
    whole = len(data) // media.BLOCK * media.BLOCK
    wave_of = lambda tail: data[: whole - 120] + tail
    same, other = (media.fingerprint(wave_of(t)) for t in (b"ab" * 60, b"a~" * 30 + b"  zz" * 15))
    assert len(same[0]) != len(other[0]) or (same[1] != other[1]).any()
    peaks = media._peaks(np.frombuffer(data, dtype=np.uint8).astype(np.float32))
    assert len(peaks) == 1 + -(-(len(data) - media.WINDOW) // media.HOP)
    want = sorted((t, a << 12 | b << 4 | dt) for t in range(len(peaks)) for dt in range(1, media.FAN + 1) if t + dt < len(peaks) for a in peaks[t] for b in peaks[t + dt] if a and b)
    times, codes = media.fingerprint(data)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == want


def units_of(text, is_license_file):
    """(kind, unit) of a text in plain Python."""
    lines = text.split("\n")
    paragraphs = re.split(licenses.PARAGRAPHS, text)
    header = []
    for line in lines:
        if not re.search(licenses.COMMENT_LINE.replace(r"\z", r"\Z"), line):
            break
        header.append(line)
    parts = lines + paragraphs + [x for p in paragraphs for x in re.split(licenses.SENTENCES, p)]
    return [("part", x) for x in parts] + [("whole", "\n".join(header))] + [("whole", text)] * is_license_file


def brute_license(path_texts):
    """Own licenses by plain dictionaries."""
    import math
    from collections import Counter

    n = sum(t is not None for _, t in path_texts)
    df = Counter(x for _, t in path_texts for x in set(licenses.terms(t or "")))
    known = {x for _, _, t in licenses.TEMPLATES for x in licenses.terms(t)}
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in known else 0))) + 1
    vec = lambda line: {t: c * idf(t) for t, c in Counter(licenses.terms(line)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for path, text in path_texts:
        best = None
        for kind, unit in units_of(text, bool(re.search(licenses.LICENSE_FILE, (path or "").split("/")[-1]))) if text is not None else []:
            a, near = vec(unit), []
            for name, of, body in licenses.TEMPLATES:
                if of != kind or not licenses.marked(name, set(a)):
                    continue
                b = vec(body)
                score = round(sum(a[t] * b[t] for t in a if t in b) / (norm(a) * norm(b)), 6) if a else 0
                if score >= licenses.MIN_COSINE:
                    near.append((0 if kind == "whole" else 2 if name in licenses.LAST else 1, -score, name))
            first = min(near, default=None)
            if first and all(x[0] != first[0] or x[2] == first[2] or round(x[1] - first[1], 6) >= licenses.MARGIN for x in near) and (best is None or first < best):
                best = first
        out.append(best)
    return out


def wrapped(text, mark, width=60):
    import textwrap

    return "\n".join(f"{mark}{x}" for x in textwrap.wrap(text, width))


def test_license_scan_and_inheritance(spark):
    rng = random.Random(6)
    part = {name: text for name, kind, text in reversed(licenses.TEMPLATES) if kind == "part"}
    whole = {name: text for name, kind, text in licenses.TEMPLATES if kind == "whole"}
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/c/x.txt", "no notice\nhere"),
        ("a/b/COPYING.md", prose(rng, 30) + "\n" + part["GPL-3.0"]),
        ("a/b/c/y.txt", "All rights reserved!\n" + prose(rng, 20)),
        ("a/z.txt", None),
        ("q/z.txt", ""),
        ("README", "Released under the new MIT License\n" + prose(rng, 5)),
        (None, part["MIT"]),
        (None, "x"),
        ("ab/LICENSE", "nothing"),
        ("ab/x.txt", "the of the"),
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Foo Inc. All rights reserved.\n\n" + wrapped(whole["MIT"], "")),
        ("m/x.c", "/*\n" + wrapped(whole["BSD-2-Clause"], " * ") + "\n */\nint main;\n" + prose(rng, 40)),
        ("m/y.py", "#!/bin/python\n# Copyright (c) 2020 Foo. All rights reserved.\n#\n" + wrapped(whole["Apache-2.0"], "# ", 40) + "\n\n" + prose(rng, 60)),
        ("m/z.txt", "Hello there. Released under the MIT License. " + prose(rng, 30)),
        ("m/w.txt", wrapped(part["BSD-3-Clause"], "// ", 30) + "\n" + prose(rng, 50)),
        ("m/w.txt", wrapped(part["BSD-3-Clause"], "// ", 30) + "\n" + prose(rng, 50)),
        ("t/LICENSE", part["CC-BY-4.0"]),
        ("t/LICENSE.txt", part["CC-BY-4.0"]),
        ("t/NOTICE", part["ISC"]),
        ("t/a.txt", "none"),
        ("m/long.txt", prose(rng, 20_000) + "\n" + wrapped(whole["GPL-3.0"], "") + "\n" + prose(rng, 100)),
    ] + [(f"d/{i}.txt", prose(rng, 40)) for i in range(40)]
    frame = spark.createDataFrame([(i, p, t, "u", "v") for i, (p, t) in enumerate(rows)], "doc_id bigint, path string, text string, license string, own string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert len(got) == len(rows)
    for i, own in enumerate(brute_license(rows)):
        assert (got[i].own_license, got[i].own_score) == ((own[2], pytest.approx(-own[1], abs=2e-6)) if own else (None, None)), rows[i]
    assert [(got[i].license, got[i].from_dir) for i in (0, 1, 2, 3, 4, 5, 8, 10)] == [("MIT", None), ("GPL-3.0", "a/b"), ("GPL-3.0", None), ("proprietary", None), ("MIT", "a"), (None, None), (None, None), (None, None)]
    assert [got[i].own_license for i in (11, 12, 13, 14, 15, 16, 21)] == ["MIT", "BSD-2-Clause", "Apache-2.0", "MIT", "BSD-3-Clause", "BSD-3-Clause", "GPL-3.0"]
    assert (got[20].license, got[20].from_dir) in (("CC-BY-4.0", "t"), ("ISC", "t"))


_GPL = "This program is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep2} either version {v} of the License, or (at your option) any later version."
#: Notices as they stand in files, and the license that they declare; None where it is none of the templates'.
NOTICES = [
    ("Released under the MIT License.", "MIT"),
    ("MIT License", "MIT"),
    ("The MIT License (MIT)\n\nCopyright (c) 2015 A. Person", "MIT"),
    ("# SPDX-License-Identifier: MIT\nimport os", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("# SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"),
    ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->", "CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"),
    ("Apache License Version 2.0, January 2004", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"),
    (_GPL.format(sep=";", sep2=",", kind="", v="2"), "GPL-2.0"),
    (_GPL.format(sep=":", sep2=",", kind="", v="3"), "GPL-3.0"),
    (_GPL.format(sep=":", sep2=",", kind="Lesser ", v="3"), "LGPL-3.0"),
    (_GPL.format(sep=";", sep2=";", kind="Lesser ", v="2.1").replace("program", "library"), "LGPL-2.1"),
    (_GPL.format(sep=":", sep2=",", kind="Affero ", v="3"), "AGPL-3.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/', "MPL-1.1"),
    # none of the templates': another version, another license, or a mere mention
    (_GPL.format(sep=";", sep2=",", kind="", v="1"), None),
    (_GPL.format(sep=";", sep2=",", kind="Library ", v="2").replace("program", "library").replace("version 2", "version 4"), None),
    ("Licensed under CC BY 3.0.", None),
    ("Licensed under CC BY-SA 3.0.", None),
    ("Licensed under CC BY 2.5.", None),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Apache License Version 1.1", None),
    ("SPDX-License-Identifier: Zlib", None),
    ("SPDX-License-Identifier: BSL-1.0", None),
    ("SPDX-License-Identifier: BSD-4-Clause", None),
    ("SPDX-License-Identifier: GPL-1.0-only", None),
    ("SPDX-License-Identifier: Unlicense", None),
    ("SPDX-License-Identifier: CC-BY-3.0", None),
    ("Released under the Boost License.", None),
    ("Released under the zlib License.", None),
    ("Mozilla Public License Version 1.0", None),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989", None),
    ("GNU Free Documentation License Version 1.3, 3 November 2008", None),
    ("Eclipse Public License - v 2.0", None),
    ("The license of this house permits 2 dogs and version 3 of the rules", None),
    ("The authors compared the MIT License with other licenses in their survey of code that students share", None),
    ("Academic Free License version 3.0", None),
    ("This is free and unencumbered software released into the public domain.", None),
]


def test_notices_as_they_stand_in_files(spark):
    rng = random.Random(9)
    assert len(NOTICES) >= 50 and sum(x is None for _, x in NOTICES) >= 20
    rows = [(i, f"n/{i}.txt", text) for i, (text, _) in enumerate(NOTICES)] + [(1000 + i, f"p/{i}.txt", prose(rng, 60)) for i in range(300)]
    got = {r.doc_id: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    wrong = [(text, want, got[i]) for i, (text, want) in enumerate(NOTICES) if got[i] != want]
    assert not wrong, wrong
    assert all(v is None for k, v in got.items() if k >= 1000)


TONGUES = {"aa": "ka ti mo su re", "bb": "ghu zeth brin olk", "cc": "çé ñu öß ła"}


def test_language_id(spark):
    rng = random.Random(7)
    word = lambda lang: "".join(rng.choice(TONGUES[lang].split()) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang, "s") for i in range(600) for lang in [("aa", "bb", "cc")[i % 3]]]
    odd = [(1000, None, "aa", None), (1001, "", None, None), (1002, "12 34 !?", "bb", None), (1003, rows[0][1], None, None), (1003, rows[0][1], None, None), (None, rows[1][1], None, None), (1004, " ".join(r[1] for r in rows if r[2] == "bb") * 60, None, None)]
    got = langid.classify(docs_of(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600}
    assert held.keys() == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == rows[i][2] for i, r in held.items()) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und"] * 3 + ["aa", "bb", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in langid.keep_identified(docs_of(spark, rows + odd)).collect()} == {i for i in range(600)} | {1003, None, 1004}


def test_language_id_against_exact_sets(spark):
    """classify() gives what sets of trigrams give in place of the filters, but where the filters' rare false hits decide."""
    rng = random.Random(17)
    word = lambda lang: "".join(rng.choice(TONGUES[lang].split()) for _ in range(rng.randrange(1, 4)))
    mixed = lambda a, b, n: " ".join(word(a if rng.random() < 0.7 else b) for _ in range(n))
    tongues = ("aa", "bb", "cc")
    rows = [(i, mixed(tongues[i % 3], tongues[(i + 1) % 3], rng.randrange(2, 50)), tongues[i % 3], "s") for i in range(300)]

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]

    from collections import Counter

    counts = {lang: Counter(g for i, t, x, _ in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1 for g in grams(t)) for lang in tongues}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    sets = {lang: {g for g, x in s.items() if x >= langid.MIN_SHARE and x >= langid.RATIO * top[g]} for lang, s in share.items()}
    differ = 0
    for r in langid.classify(docs_of(spark, rows)).collect():
        found = grams(rows[r.doc_id][1])
        hits = {lang: sum(g in sets[lang] for g in found) for lang in tongues}
        best = min(tongues, key=lambda x: (-hits[x], x))
        if r.lang_pred != best:
            differ += 1
            assert abs(hits[r.lang_pred] - hits[best]) <= 1
        else:
            assert r.score == pytest.approx(hits[best] / len(found), abs=0.02)
    assert differ <= 3


def test_more_languages_than_a_table_has(spark, monkeypatch):
    """Languages of all tables are learned, and several tables predict what one does."""
    letters = lambda k: [chr(0x4E00 + 50 * k + j) for j in range(50)]
    rng = random.Random(23)
    # neighbours share letters and equal texts have two languages, so that languages of different tables compete
    text = lambda k: " ".join("".join(rng.choices(letters(k) + letters(k + 1)[:9], k=3)) for _ in range(30))
    rows = [(i, text(i % 150), f"l{i % 150:03}", "s") for i in range(600)]
    rows += [(i, text(200), lang, "s") for i, lang in ((700, "l010"), (701, "l140"))] + [(702, None, "l001", "s"), (703, "12 3", "l002", "s")]
    docs = docs_of(spark, rows)
    one = langid.fit(docs)
    expected = [one.predict(r[1]) for r in rows]
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.classify(docs).collect()}
    monkeypatch.setattr(langid, "TABLE_LANGUAGES", 64)
    model = langid.fit(docs)
    assert len(one.parts) == 1 and len(model.parts) == 3 and model.languages == one.languages == [f"l{k:03}" for k in range(150)]
    assert np.array_equal(one.false_rate, model.false_rate)
    assert [model.predict(r[1]) for r in rows] == expected
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.classify(docs).collect()} == whole
    assert sum(p[0] == r[2] for p, r in zip(expected, rows[:600])) >= 590 and expected[-2:] == [("und", 0.0)] * 2


CLASHING = "row text_key dirty keeper nth lang_ src key ties last epochs side times rank n g k t v part tie out whole of before others size shard slot law own_size grown_shard text_crc32 node root doc_id_ id".split()


def test_columns_of_any_name_pass_through_the_stages(spark):
    """Columns named like every helper column keep their values in each filtering stage and, renamed where needed, in sharding."""
    from pyspark.sql import functions as F

    rows = [(i, f"{prose(random.Random(i), 20)} w{i}", "en", f"s{i % 3}") for i in range(40)] + [(1, f"{prose(random.Random(1), 20)} w1", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING})
    bench = spark.createDataFrame([(1, rows[5][1])], "item_id bigint, text string")
    stages = [langid.keep_identified, simhash.keep_one, lambda d: decontam.clean(d, bench), mixing.mix]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}-{r.doc_id}" for r in found for c in CLASHING)
    placed = sharding.assign(docs, keep_columns=True)
    assert len({c.lower() for c in placed.columns}) == len(placed.columns)
    r = placed.first()
    assert r["own_slot"] == f"slot-{r.doc_id}" and r["own_size"] == f"own_size-{r.doc_id}" and r["own_own_size"] == f"size-{r.doc_id}" and r["row"] == f"row-{r.doc_id}"


def test_trigrams_of_pieces(monkeypatch):
    text = "Ein Text, der in Stücken gelesen wird: 1 2 3."
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "CHUNK", 5)
    assert langid.trigrams(text).tolist() == whole.tolist()


def test_language_model_of_many_languages_and_none(spark):
    rows = [(i, "".join(chr(0x4E00 + 50 * k + j % 40) + chr(0x4E00 + 50 * k + (j * 7) % 40) for j in range(60)), f"l{k:03}", "s") for i, k in enumerate(list(range(70)) * 2)]
    model = langid.fit(docs_of(spark, rows))
    assert [t.shape[1] for _, t in model.tables()] == [2] and all(model.predict(r[1])[0] == r[2] for r in rows)
    assert langid.fit(docs_of(spark, [(1, "abc", None, "s")])).predict("abc") == ("und", 0.0)


EMPTY_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_empty_tables(spark, tmp_path):
    for name, schema in {"documents": EMPTY_DOCS, "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert not differences(QUERIES[name](spark, sf_dir).toPandas(), run_sql(ORACLES[name], sf_dir))


def test_decoded_references_match_the_library():
    assert htmlmain.main_text("<p>&lt;b&gt; &eacute;&#x41;</p>") == html.unescape("&lt;b&gt; &eacute;&#x41;")
