"""Commits, the paged source, resumable collection, nested reports, grouping by segments and samples by label."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lettermill.operators import datasets, evaluation
from lettermill.sources import committed, paged, sinks
from lettermill.streaming import jobs


def test_a_commit_shows_all_its_parts_or_none(spark, tmp_path):
    log, a, b = (f"{tmp_path}/{x}" for x in ("log", "a", "b"))
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    read = lambda p: sorted(r.x for r in committed.read(spark, log, p, "x int").collect())
    assert read(a) == [] and not committed.is_committed(spark, log, "k1")
    failing = one.select(F.raise_error(F.lit("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        committed.commit({a: one, b: failing}, log, "k1")
    assert os.listdir(a) and read(a) == [] and read(b) == []
    assert committed.commit({a: one, b: two}, log, "k1") and read(a) == [1] and read(b) == [2]
    assert not committed.commit({a: one, b: two}, log, "k1") and read(a) == [1]
    assert committed.commit({a: two}, log, "k2") and read(a) == [1, 2] and read(b) == [2]
    for wrong in ("", "a/b", "../x", "_k", ".k"):
        with pytest.raises(ValueError):
            committed.commit({a: one}, log, wrong)
    with pytest.raises(ValueError):
        committed.commit({a: one, f"{a}/": one}, log, "k3")


def test_the_second_of_two_writers_of_a_commit_changes_nothing(spark, tmp_path, monkeypatch):
    log, a = f"{tmp_path}/log", f"{tmp_path}/a"
    rows = spark.createDataFrame([(1,)], "x int")
    real = committed.is_committed
    asked = []

    def late(spark, log, key):
        asked.append(1)
        if len(asked) == 1:  # another writer commits while this one believes that nobody has
            monkeypatch.setattr(committed, "is_committed", real)
            assert committed.commit({a: rows}, log, "k")
            monkeypatch.setattr(committed, "is_committed", late)
            return False
        return real(spark, log, key)

    monkeypatch.setattr(committed, "is_committed", late)
    assert not committed.commit({a: rows.withColumn("x", F.lit(9))}, log, "k")
    assert [r.x for r in committed.read(spark, log, a, "x int").collect()] == [1]
    assert not [f for f in os.listdir(log) if f.startswith(".k-") and not f.endswith(".crc")]


def test_redacted_rows_and_audit_lie_apart_and_are_seen_together(spark, tmp_path):
    rows, audit = spark.createDataFrame([(1, "[EMAIL]")], "id int, text string"), spark.createDataFrame([("1", "a@b.nl")], "record_id string, original string")
    text, values = f"{tmp_path}/text", f"{tmp_path}/audit"
    assert sinks.save_redacted(rows, audit, text, values) and not sinks.save_redacted(rows, audit, text, values)
    assert sinks.read_redacted(spark, text, "id int, text string").collect()[0].text == "[EMAIL]"
    assert sinks.read_audit(spark, text, values, "record_id string, original string").count() == 1
    assert "a@b.nl" not in "".join(open(os.path.join(d, f), errors="replace").read() for d, _, fs in os.walk(text) for f in fs)
    for inside in (text, f"{text}/audit", str(tmp_path)):
        with pytest.raises(ValueError):
            sinks.save_redacted(rows, audit, text, inside)


# ---------------------------------------------------------------- pages


def land(root, pages):
    for n, body in pages.items():
        os.makedirs(f"{root}/page_no={n}", exist_ok=True)
        with open(f"{root}/page_no={n}/part-0.txt", "w") as f:
            f.write(body)
        open(f"{root}/page_no={n}/_SUCCESS", "w").close()


def test_paged_source_reads_ranges_limits_and_filters(spark, tmp_path):
    paged.register(spark)
    root = f"{tmp_path}/feed"
    land(root, {n: f"page {n} é\n" for n in range(11)})
    os.makedirs(f"{root}/other")
    read = lambda **o: spark.read.format("pages").options(**o).load(root)
    rows = read(pages_a_partition=4)
    assert rows.rdd.getNumPartitions() == 3 and sorted((r.feed, r.page_no, r.body) for r in rows.collect()) == sorted(("feed", n, f"page {n} é\n") for n in range(11))
    assert {r.page_no for r in read(max_pages=3).collect()} == {0, 1, 2} and read(feed="x").first().feed == "x"
    some = read(pages_a_partition=1).where("page_no > 2 and page_no <= 5 and body like 'page%'")
    assert sorted(r.page_no for r in some.collect()) == [3, 4, 5] and some.rdd.getNumPartitions() == 3
    assert spark.read.format("pages").load(f"{tmp_path}/nothing").collect() == []
    uri = spark.read.format("pages").load(f"file://{root}")
    assert uri.count() == 11


def turned(pages, full):
    """What a collector reads, turning pages one by one."""
    seen, out, n = set(), [], min(pages, default=0)
    while n in pages and pages[n]:
        out.append(n)
        new = set(pages[n]) - seen
        seen |= new
        if not new or len(pages[n]) < full:
            break
        n += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reached_pages_are_those_of_a_collector(spark, seed):
    rng = random.Random(seed)
    feeds = {}
    for feed in ("a", "b", "c", None):
        pages = {n: [f"{rng.randint(0, 12)}" for _ in range(rng.choice((3, 3, 3, 3, 2, 0)))] for n in range(rng.randint(0, 9)) if rng.random() > 0.05}
        feeds[feed] = pages
    rows = [(f, n, ids) for f, pages in feeds.items() for n, ids in pages.items()] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "feed string, page_no int, ids array<string>")
    got = sorted(((r.feed, r.page_no) for r in paged.reached(df, F.col("ids"), 3).collect()), key=repr)
    assert got == sorted(((f, n) for f, pages in feeds.items() for n in turned(pages, 3)), key=repr)


def test_a_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    paged.register(spark)
    root, out = f"{tmp_path}/feed", f"{tmp_path}/out"

    def run():
        jobs.collect_new(spark.readStream.format("pages").option("pages_a_partition", 2).load(root), out, f"{tmp_path}/state").awaitTermination()
        return sorted(r.page_no for r in spark.read.parquet(out).collect())

    land(root, {0: "a", 1: "b", 3: "d"})
    assert run() == [0, 1] and run() == [0, 1]
    land(root, {2: "c", 4: "e"})
    assert run() == [0, 1, 2, 3, 4]


# ---------------------------------------------------------------- resume


def test_nothing_is_collected_twice_after_any_pause_or_a_lost_checkpoint(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "id string, ts timestamp, note string"

    def land_rows(*rows):
        spark.createDataFrame([(i, t, n) for i, t, n in rows], "id string, t string, note string").select("id", F.to_timestamp("t").alias("ts"), "note").write.mode("append").parquet(src)

    def run(state="state"):
        jobs.collect_unseen(jobs.read_landing(spark, src, spark.read.parquet(src).schema), "id", out, f"{tmp_path}/{state}", ("ts", "note")).awaitTermination()
        return sorted(((r.id, r.note) for r in jobs.collected(spark, out, schema).collect()), key=repr)

    land_rows(("a", "2020-01-01", "first"), ("a", "2019-01-01", "earlier"), ("b", "2020-01-01", "x"), (None, "2020-01-01", "none"))
    first = run()
    assert first == sorted([("a", "earlier"), ("b", "x"), (None, "none")], key=repr)
    land_rows(("a", "2031-01-01", "years later"), ("c", "1990-01-01", "late"), ("b", "2020-01-01", "x"))
    assert run() == sorted([*first, ("c", "late")], key=repr)
    again = run("another-checkpoint")
    assert [r for r in again if r[0]] == [("a", "earlier"), ("b", "x"), ("c", "late")]


# ---------------------------------------------------------------- reports, segments, samples


def test_every_value_of_a_report_comes_back(spark, tmp_path):
    report = {"model": "m", "evaluations": {"set": {"default": {"macro_f1": 0.5, "f1_klacht_argmax": 1, "n": "12 rows", "flag": True, "list": [1, 2], "none": None, "thresholds_per_label": {"klacht": 0.25, "beroep": "?"}}}, "empty": {}}}
    for name, text in (("good.json", json.dumps(report)), ("broken.json", "{"), ("other.json", "[]")):
        (tmp_path / name).write_text(text)
    rows = {(r.metric, r.label): (r.value, r.text) for r in sinks.read_report_values(spark, *[str(tmp_path / x) for x in ("good.json", "broken.json", "other.json")]).collect()}
    assert rows["macro_f1", None][0] == 0.5 and rows["f1_klacht_argmax", None][0] == 1.0 and rows["thresholds_per_label", "klacht"][0] == 0.25
    assert rows["n", None] == (None, "12 rows") and rows["thresholds_per_label", "beroep"] == (None, "?") and rows["none", None] == (None, None) and ("list", None) in rows
    numbers = {r.metric: r.value for r in sinks.read_reports(spark, str(tmp_path / "good.json")).collect()}
    assert {"macro_f1", "f1_klacht_argmax"} <= set(numbers) and "thresholds_per_label" not in numbers


def test_segments_in_one_pass_are_those_of_separate_passes(spark):
    rng = random.Random(3)
    rows = [(i, "e", [rng.uniform(-3, 3) for _ in range(9)], ["klacht"] if rng.random() < 0.4 else ["beroep"], rng.choice(["x", None, "y"]), rng.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, eval_set string, logits array<double>, labels array<string>, part string, half int")
    found = evaluation.segment_scores(df, ((), ("part",), ("part", "half")))
    for level, keys in (("", ()), ("part", ("part",)), ("part,half", ("part", "half"))):
        apart = evaluation.label_scores(df, keys=("eval_set", *keys)).where("family = 'threshold'")
        want = sorted(((*[r[k] for k in keys], r.label, r.tp, r.n_pred, r.n_true, round(r.f1, 9)) for r in apart.collect()), key=repr)
        got = sorted(((*[r[k] for k in keys], r.label, r.tp, r.n_pred, r.n_true, round(r.f1, 9)) for r in found.where(F.col("level") == level).collect()), key=repr)
        assert got == want
    assert found.select("level").distinct().count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    assert evaluation.segment_scores(df, ((),)).count() == 9


def test_samples_by_label_have_exact_sizes_and_merge(spark):
    rows = [(i, [["klacht"], ["klacht", "beroep"], [], None][i % 4] if i != 77 else ["zienswijze", "zienswijze"], "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, labels array<string>, label string")
    got = datasets.sample_by_label(df.drop("label"), 15)
    sizes = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert sizes == {"klacht": 15, "beroep": 15, datasets.NONE: 15, "zienswijze": 1}
    parts = datasets.sample_by_label(df.where("id < 200").drop("label"), 15).unionByName(datasets.sample_by_label(df.where("id >= 200").drop("label"), 15)).drop("label", "nth").distinct()
    merged = datasets.sample_by_label(parts, 15)
    assert sorted((r.label, r.nth, r.id) for r in merged.collect()) == sorted((r.label, r.nth, r.id) for r in got.collect())
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_records_of_a_large_feed_are_read_in_parts(spark, tmp_path):
    from lettermill.sources import rulings

    rec = lambda i, body="": f'<open-rechtspraak a="1">\n<m:identifier>ECLI:{i}</m:identifier>\n<uitspraak><para>tekst {i} &lt;b&gt;</para>{body}</uitspraak></open-rechtspraak>\n'
    whole = "<?xml version='1.0'?>\n<feed xmlns:m=\"u\">\n" + "".join(rec(i) for i in range(60)) + "<open-rechtspraak><uitspraak>kapot\n" + rec(60) + "<open-rechtspraak-x>no</open-rechtspraak-x>" + rec(61, "<b>") + "</feed>"
    (tmp_path / "feed.xml").write_text(whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = rulings.read_feed_records(spark, str(tmp_path / "feed.xml"), declarations='xmlns:m="u"')
        assert rows.rdd.getNumPartitions() > 4
        got = {r.ecli: r.full_text for r in rulings.parse_rulings(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"ECLI:{i}": f"tekst {i} <b>" for i in range(61)} | {"ECLI:61": None}


def test_phrases_are_counted_as_by_one_scan_each(spark):
    import re

    from lettermill.operators import phrases

    rng = random.Random(5)
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice("ab bc Ab cd ée".split()) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "")]
    wanted = ["ab", "AB bc", "bc, cd", "cd cd ab", "ée", "nothing here", "", None, "ab bc"]
    got = {(r.id, r.phrase): r.n for r in phrases.phrase_counts(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in wanted], "phrase string")).collect()}
    want = {}
    for i, text in texts:
        w = re.findall(r"\w+", (text or "").lower())
        for p in {" ".join(re.findall(r"\w+", (p or "").lower())) for p in wanted} - {""}:
            n = p.count(" ") + 1
            found = sum(" ".join(w[j : j + n]) == p for j in range(len(w) - n + 1))
            if found:
                want[i, p] = found
    assert got == want and len(want) > 50
    none = spark.createDataFrame([(None,)], "phrase string")
    assert phrases.phrase_counts(spark.createDataFrame(texts, "id int, text string"), none).collect() == []


def test_the_feed_of_rulings_is_written_by_many_tasks(spark, tmp_path):
    """No part of the document holds most of the rulings, and the parts in order of their names are the document."""
    import xml.etree.ElementTree as ET
    from pathlib import Path

    from lettermill import queries_sources
    from lettermill.functions import storage

    spark.range(1, 400).selectExpr("id * 9 + 1 AS o_orderkey", "timestamp_ntz'2024-01-02' AS o_orderdate", "'x' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    rows = queries_sources.ruling_feed_file(spark, str(tmp_path)).count()
    out = next(p for p in reversed(storage._given[spark.sparkContext.applicationId]) if "/feed-" in p)
    parts = [p.read_text() for p in sorted(Path(out).glob("part-*"))]
    assert rows == 399 and max(p.count("</open-rechtspraak>") for p in parts) < 200
    assert len(ET.fromstring("".join(parts))) == 399


def test_long_feeds_are_read_by_few_ranges_and_landed_by_all_cores(spark, tmp_path):
    """Ranges grow with the feed, so their number does not; every page has one file, and several tasks wrote them."""
    from pathlib import Path

    from lettermill.queries_sources import _land

    folder = paged._Folder({"path": str(tmp_path)})
    for n in (0, 5, 1000, 100_000):
        ranges = folder.ranges(range(n))
        assert [p for r in ranges for p in r.value] == list(range(n)) and len(ranges) <= 256
    assert len(folder.ranges(range(64))) == 4 and len(paged._Folder({"path": "x", "pages_a_partition": "1"}).ranges(range(300))) == 300
    _land(spark.range(0, 40, 1, 1).selectExpr("CAST(id AS int) AS page_no", "'x' AS value"), f"{tmp_path}/feed")
    names = [p.name for p in Path(f"{tmp_path}/feed").glob("page_no=*/part-*")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1
