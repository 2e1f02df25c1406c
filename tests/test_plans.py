"""Plans compute what they should once, and helpers of storage, paging and packing."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from lettermill.functions import storage
from lettermill.functions.once import packed, with_once
from lettermill.functions.spans import MARK, find_spans
from lettermill.llm import neardup
from lettermill.operators import redaction
from lettermill.queries import QUERIES
from lettermill.sources import council, paging


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_ruling_is_parsed_and_scanned_once(spark):
    plan = optimized(QUERIES["ruling_xml"](spark, "/root/testdata/sf0.001"))
    assert plan.count("XPathString") + plan.count("xpath_string(") <= 1 and plan.count("from_xml") <= 1
    plan = optimized(QUERIES["ruling_signals"](spark, "/root/testdata/sf0.001"))
    assert plan.count("regexp_extract_all(") == 1
    spans = optimized(redaction.stats(redaction.with_spans(spark.createDataFrame([("x",)], "text string"))))
    assert spans.count("@") <= 8


def test_once_replaces_columns_and_packed_keeps_them_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    out = with_once(df, text=F.upper("text"), n=F.length("text"))
    assert out.columns == ["id", "text", "n"] and sorted(map(tuple, out.collect())) == [(1, "A", 1), (2, None, None)]
    clash = spark.createDataFrame([(1, 2)], "row int, key int")
    assert packed(clash, key=F.lit(9)).where("key = 9").select("row.*").collect() == clash.collect()


def test_spans_of_texts_that_hold_the_mark(spark):
    texts = ["12 ab 345", f"{MARK}12{MARK} ab 345", "", None, "none", "7"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(s.start, -s.neg_end, s.original) for s in r.s] for r in df.select(find_spans(F.col("text"), r"\d+", "N", "#").alias("s")).collect()]
    assert got == [[(0, 2, "12"), (6, 9, "345")], [(1, 3, "12"), (8, 11, "345")], [], [], [], [(0, 1, "7")]]


def test_pages_up_to_a_limit(spark):
    rows = [("a", 3), ("a", 4), ("a", 5), (None, 1), (None, 2), (None, 3), ("b", None)]
    pages = spark.createDataFrame(rows, "feed string, page_no int")
    assert sorted(map(tuple, paging.first_pages(pages, 2, by=("feed",)).collect()), key=repr) == sorted([("a", 3), ("a", 4), (None, 1), (None, 2)], key=repr)
    assert paging.first_pages(pages, 2).count() == 2 and paging.first_pages(pages, None).count() == 7


def test_hits_without_an_id_are_all_kept(spark):
    page = '{"hits": {"hits": [{"_id": "x", "_source": {"name": "one"}}, {"_source": {"name": "two"}}, {"_source": {"name": "two"}}, {"_id": "x", "_source": {"name": "three"}}]}}'
    pages = spark.createDataFrame([(2, page), (1, page.replace("one", "first")), (3, "broken")], "page_no int, page string")
    assert sorted(r.name for r in council.hits(pages).collect()) == ["first", "two", "two", "two", "two"]


def test_written_tables_can_be_cleaned_up(spark):
    kept = storage.cut(spark.range(3))
    path = storage._given[spark.sparkContext.applicationId][-1]
    assert kept.count() == 3 and os.path.isdir(path)
    given, storage._given[spark.sparkContext.applicationId] = storage._given[spark.sparkContext.applicationId], [path]
    assert storage.clean_up(spark) == 1 and not os.path.exists(path)
    storage._given[spark.sparkContext.applicationId] = [p for p in given if p != path]


def test_tables_of_steps_are_deleted_also_when_a_step_fails_and_by_their_own_thread(spark):
    import threading

    import pytest

    def written(df):
        return storage._given[spark.sparkContext.applicationId][-1]

    with storage.steps_to_one_table(spark):
        storage.cut(spark.range(1))
        first = written(None)
        with storage.steps_to_one_table(spark):
            storage.cut(spark.range(2))
            inner = written(None)
            storage.cut(spark.range(2))
            handed = written(None)
        assert not os.path.exists(inner) and os.path.exists(handed)
        other: list[str] = []

        def elsewhere():
            storage.cut(spark.range(5))
            other.append(written(None))

        thread = threading.Thread(target=elsewhere)
        thread.start()
        thread.join()
        storage.cut(spark.range(3))
        last = written(None)
    assert [os.path.exists(p) for p in (first, handed, last, other[0])] == [False, False, True, True]
    with pytest.raises(RuntimeError), storage.steps_to_one_table(spark):
        storage.cut(spark.range(1))
        lost = written(None)
        raise RuntimeError
    assert not os.path.exists(lost) and lost not in storage._given[spark.sparkContext.applicationId]


def test_shuffles_of_a_written_table_are_deleted(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    before, mode = shuffled(), spark.conf.get(storage._CLEANUP)
    grouped = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()
    table = storage.cut(grouped)
    for _ in range(40):
        if not (left := shuffled() - before):
            break
        time.sleep(0.25)
    assert not left and table.count() == 1000 and grouped.count() == 1000 and spark.conf.get(storage._CLEANUP) == mode


def test_prefixes_are_joined_to_pairs_that_parities_leave(spark, monkeypatch):
    # 200 sets that share 30 of 100 shingles: every pair meets, none is similar
    draw = np.random.default_rng(7).integers(0, 1 << 63, 30 + 200 * 70, dtype=np.uint64)
    rows = [(n, 100, list(range(30)), neardup._parities(np.append(draw[:30], draw[30 + 70 * n : 100 + 70 * n])).tolist()) for n in range(200)]
    of = storage.cut(spark.createDataFrame(rows, "node bigint, size int, keys array<bigint>, odd array<bigint>"))
    pairs = of.select(F.col("node").alias("a")).crossJoin(of.select(F.col("node").alias("b"))).where("a < b")
    written = []
    monkeypatch.setattr(neardup, "cut", lambda df: written.append(storage.cut(df)) or written[-1])
    assert neardup._shared_keys(pairs, of).count() == 0 and [t.count() for t in written] == [0, 0, 0]
    twins = of.union(of.withColumn("node", F.col("node") + 1000))
    some = twins.select(F.col("node").alias("a"), (F.col("node") + 1000).alias("b")).where("a < 1000")
    assert some.count() == 200 and set(map(tuple, neardup._shared_keys(some, twins).select("x", "y", "n").collect())) == {(100, 100, 30)}


def test_hubs_and_stars_make_pairs_of_sizes_that_allow_the_similarity_only(spark, monkeypatch):
    """A passage in texts of all sizes: those that differ too much in size are no pair of the second round, and no pair carries shingles that one text alone has."""
    from lettermill.llm import simhash

    rng = np.random.default_rng(5)
    texts = []
    for i in range(150):
        words = [f"p{j}" for j in range(100 + 40 * (i % 6))]
        for at in rng.choice(len(words), len(words) // 37, replace=False):
            words[at] = f"w{rng.integers(10**9)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    seen, carried = [], []
    shared_keys = neardup._shared_keys

    def spy(pairs, of, keys=None):
        size = of.select("node", "size")
        of_both = pairs.join(size.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b")
        seen.append(of_both.selectExpr("count(*)", "count_if(5 * least(sa, sb) < 4 * greatest(sa, sb))", "count_if(y <> sb)").first())
        whole = of.select(F.explode("keys").alias("key"), "node").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        carried.append((keys.count(), keys.select(F.explode("keys").alias("key")).join(whole, "key").count()))
        return shared_keys(pairs, of, keys)

    monkeypatch.setattr(neardup, "_shared_keys", spy)
    kept = simhash.keep_one(docs).count()
    sets = [set(neardup.shingles(t).tolist()) for _, t in texts]
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in ((i, j) for i in range(150) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
        parent[find(i)] = find(j)
    assert kept == len({find(i) for i in range(150)})
    assert seen[1][0] > 100 and seen[1][1] == 0 and not any(wrong for *_, wrong in seen)
    assert carried[0][0] > 0 and not any(alone for _, alone in carried)
