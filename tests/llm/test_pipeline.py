"""The pipeline, stage by stage, against plain Python over a small corpus."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lettermill.llm import decontam, langid
from tests.llm.test_operators import TONGUES, brute_overlap, component_of, xxh_fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    word = lambda lang: "".join(rng.choice(TONGUES[lang].split()) for _ in range(rng.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(i, text("aa", 20)) for i in range(5)]
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        words = text(lang, rng.randrange(3, 90)).split()
        if i % 17 == 0:
            words[1:1] = items[i % 5][1].split()
        rows.append([i, " ".join(words), lang, f"s{i % 4}" if i % 11 else None])
    for i in range(0, 60, 3):  # exact copies, and copies with other capitals
        rows.append([1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2], "s9"])
    rows += [[2000, None, "aa", "s1"], [2001, "12 !!", "bb", "s1"], [2002, "", None, None]]
    return [(*r, len(r[1] or "")) for r in rows], items


def word_count(text):
    return len((text or "").encode().split())


def brute_trigrams(text):
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]


def brute_language_id(rows):
    """Exact sets in place of the Bloom filters; rejects texts without a letter."""
    return [r for r in rows if brute_trigrams(r[1] or "")]


def brute_dedup(rows):
    fps = [(r[0], xxh_fingerprint(r[1])) for r in rows]
    return [r for r, c in zip(rows, component_of(fps), strict=True) if r[0] == c]


def brute_clean(rows, items):
    return [r for r in rows if not any(brute_overlap(r[1], b) for _, b in items)]


def brute_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += word_count(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / free > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        budget = round(3 * sizes[s] if s in capped else left * weight[s] / free)
        at = (budget % sizes[s]) if sizes[s] else 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = word_count(r[1])
            times = budget // sizes[s] + (at > 0 and n > 0)
            at -= n
            out += [r] * times
    return out


def brute_shard(doc_id, n):
    def score(i):
        return -math.log((int(hashlib.md5(f"{doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)

    return min(range(n), key=score)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows, items = corpus()
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]


def test_every_stage_equals_plain_python(spark, data):
    path, rows, items = data
    brute = [brute_language_id, brute_dedup, lambda r: brute_clean(r, items), brute_mix]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute, strict=False):
        given = sorted((tuple(r) for r in docs.collect()), key=repr)
        docs = corpus_pipeline.cut(stage(spark, docs, path))
        assert docs.columns == columns, name
        assert sorted((tuple(r) for r in docs.collect()), key=repr) == sorted(plain(given), key=repr), name
    given = Counter(tuple(r) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    slots = defaultdict(list)
    for r in last.collect():
        given[(r.doc_id, r.text, r.lang, r.source, r.n_chars)] -= 1
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, 8), brute_shard(r.doc_id, 9))
        assert (r.size, r.text_crc32, r.law) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()), "key")
        slots[r.shard].append(r.slot)
    assert not any(given.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_equals_its_stages_and_repeats(spark, data):
    path, rows, items = data
    first = sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=repr)
    again = sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=repr)
    kept = brute_mix(brute_clean(brute_dedup(brute_language_id(rows)), items))
    assert first == again and len(first) == len(kept)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_nulls_only(spark, tmp_path):
    spark.createDataFrame([(None, None, None, None, None)] * 3 + [(None, "some words here", None, None, 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).collect()


def test_trigrams_and_tokens_as_in_plain_python(data):
    for t in [r[1] for r in data[1][:50] if r[1]]:
        assert langid.trigrams(t).tolist() == [ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in brute_trigrams(t)]
    assert re.findall(decontam._TOKEN, "a_b c-d") == ["a_b", "c", "d"]


def test_near_dedup_links_all_texts_of_jaccard_four_fifths(spark):
    """Near copies, wider apart than op1's 3 bits, against all pairs; with null and shared ids."""
    rng = random.Random(8)
    rows = []
    for i in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(4, 260))]
        for k in range(6):
            rows.append((10 * i + k if (i + k) % 4 else None, " ".join(words), "en", "s", 1))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
    common = [f"c{j}" for j in range(30)]
    rows += [(1000 + i, " ".join([*common, f"y{i}", f"z{i}"][i % 3 :]), "en", "s", 1) for i in range(40)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [grams(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
                far += (xxh_fingerprint(rows[i][1]) ^ xxh_fingerprint(rows[j][1])).bit_count() > 3
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    want = sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=repr)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()), key=repr)
    assert got == want and far > 50


def test_rows_without_an_id_are_decontaminated_and_deduplicated(spark, tmp_path):
    rng = random.Random(9)
    item = " ".join(f"b{rng.randrange(999)}" for _ in range(20))
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    near = [*base[:100], "changed", *base[101:]]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {item} after"), (None, " ".join(base)), (None, " ".join(near)), (5, f"{item} five"), (6, "clean six words of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    clean = {(r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()}
    assert clean == {rows[1], rows[2], rows[4]}
    kept = [r.text for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert len(kept) == 3 and (" ".join(base) in kept) != (" ".join(near) in kept)


def test_parities_never_rule_out_similar_sets():
    """The bits in which two nodes differ are no more than the shingles that only one of them has."""
    import numpy as np

    from lettermill.llm import neardup

    rng = random.Random(4)
    for size in (0, 1, 5, 40, 300, 5000):
        for _ in range(20):
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], dtype=np.uint64))
            kept = a[np.array([rng.random() < 0.85 for _ in a], dtype=bool)] if size else a
            b = np.unique(np.append(kept, np.array([rng.getrandbits(64) for _ in range(rng.randint(0, size // 5 + 1))], dtype=np.uint64)))
            differ = sum(bin(int(x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(neardup._parities(a), neardup._parities(b), strict=True))
            assert len(neardup._parities(a)) * 64 == neardup.PARITY_BITS and differ <= len(np.setxor1d(a, b))


def test_near_texts_that_are_not_near_enough_make_no_pairs(spark):
    """Many texts with common passages, each below 0.8 to all others: nothing is linked and nothing is compared in the last round."""
    from lettermill.llm import neardup, simhash

    rng = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(120):
        words = list(base)
        for _ in range(14):
            words[rng.randrange(300)] = f"x{i}-{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    sets = [set(neardup.shingles(t).tolist()) for _, t in texts]
    want = {(i, j) for i in range(120) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    assert kept == {find(i) for i in range(120)} and len(kept) > 60
