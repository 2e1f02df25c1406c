"""Labels, splits, metrics, comparison, agreement, model and streams, against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.functions import labels as L
from lettermill.functions import ranks
from lettermill.operators import agreement, datasets, evaluation
from lettermill.plans import classifier
from lettermill.sources import sinks
from lettermill.streaming import jobs

LABELS = list(L.LABELS)


def rows_of(n, seed=0):
    rng = random.Random(seed)
    return [(i, "ab"[i % 2], sorted(rng.sample(LABELS[:8], rng.choice([0, 1, 1, 2])), key=lambda _: rng.random()), [round(rng.uniform(-3, 3), 2) for _ in LABELS]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, eval_set string, labels array<string>, logits array<double>")


def test_label_vectors(spark):
    df = spark.createDataFrame([(["klacht", "x"], [0.1, 0.9, 0.5, 0.9, 0.2, 0.0, 0.0, 0.0, 0.49])], "l array<string>, p array<double>")
    r = df.select(L.encode(F.col("l")), L.decode(F.col("p")), L.decode(F.col("p"), 0.9), L.argmax(F.col("p")), L.ranked(F.col("p")), L.id_of(F.lit("klacht")), L.id_of(F.lit("x")), L.decode_per_class(F.col("p"), F.array(*[F.lit(t) for t in [0.0] + [1.0] * 8])), L.encode(F.lit(None).cast("array<string>"))).first()
    assert r[0] == [0, 0, 0, 1, 0, 0, 0, 0, 0] and r[1] == ["bezwaar", "beroep", "klacht"] and r[2] == ["bezwaar", "klacht"] and r[3] == 1
    assert [tuple(x) for x in r[4]] == [(0.9, "klacht"), (0.9, "bezwaar"), (0.5, "beroep")] and r[5] == 3 and r[6] is None and r[7] == ["aanvraag"] and r[8] == [0.0] * 9


def test_classify_blank_and_abstain(spark):
    df = spark.createDataFrame([("x", [0.9] + [0.1] * 8), (" ", [0.9] + [0.1] * 8), (None, [0.9] * 9), ("y", [0.2] * 9)], "text string, p array<double>")
    got = L.classify(df, "text", "p").collect()
    assert [(r.top_label, len(r.above), r.abstains) for r in got] == [("aanvraag", 1, False), (None, 0, True), (None, 0, True), ("aanvraag", 0, True)]


def test_distributions_union_unseen_funnel(spark):
    df = frame(spark, rows_of(50))
    assert {r.label: r.n for r in datasets.label_distribution(df).collect()} == Counter(x for r in rows_of(50) for x in r[2])
    assert datasets.union_all(df, df.drop("logits")).count() == 100
    new = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert sorted((r.k for r in datasets.unseen(new, spark.createDataFrame([(2,), (None,)], "k int"), "k").collect()), key=str) == [1, None]
    f = datasets.funnel(df, ("eval_set",), even=F.col("id") % 4 == 0).collect()
    assert {(r.eval_set, r.total, r.even) for r in f} == {("a", 25, 13), ("b", 25, 0)}
    dim = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError, match="b"):
        datasets.domain_check(df, "eval_set", dim, "s")
    assert datasets.domain_check(df.where("eval_set = 'a'"), "eval_set", dim, "s").count() == 25


def test_stratified_split_is_a_partition_by_rarest_label(spark):
    rows = rows_of(300)
    counts = Counter(x for r in rows for x in r[2])
    got = datasets.stratified_split(frame(spark, rows)).collect()
    assert sorted(r.id for r in got) == list(range(300))
    by = defaultdict(Counter)
    for r in got:
        assert r.bucket == (min(r.labels, key=lambda x: counts[x]) if r.labels else "__none__")
        by[r.bucket][r.split] += 1
    for c in by.values():
        n = sum(c.values())
        assert (c["train"], c["val"]) == (int(n * 0.7), int(n * 0.15))
    again = datasets.stratified_split(frame(spark, rows[::-1]).repartition(3)).collect()
    assert {(r.id, r.split) for r in again} == {(r.id, r.split) for r in got}
    assert {r.id for r in datasets.stratified_split(frame(spark, rows), seed=1).where("split = 'val'").collect()} != {r.id for r in got if r.split == "val"}


def test_random_and_external_split(spark):
    c = Counter(r.split for r in datasets.random_split(frame(spark, rows_of(100))).collect())
    assert c == {"train": 70, "val": 15, "test": 15}
    ext = Counter(r.split for r in datasets.external_split(frame(spark, rows_of(85)), frame(spark, rows_of(10)), stratified=False).collect())
    assert ext["train"] == 70 and ext["val"] == 15 and ext["test"] == 10
    for bad in ((0.9, 0.1), (0.0, 0.0)):
        with pytest.raises(ValueError):
            datasets.random_split(frame(spark, rows_of(3)), *bad)
    assert datasets.stratified_split(frame(spark, [])).count() == 0
    report = datasets.metadata_report(datasets.random_split(frame(spark, rows_of(100))).withColumn("source", F.lit("gold"))).first()
    assert report.n_total == 100 and report.source_distribution == {"gold": 100}
    assert 20 < datasets.hash_sample(frame(spark, rows_of(1000)), 0.05).count() < 90


def test_ranks_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 7)
    df = spark.range(300).select("id", F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 2).alias("g"))
    got = ranks.group_ranks(df, "g", "k", ["id"], "r").collect()
    for g in (0, 1):
        assert [r.r for r in sorted((x for x in got if x.g == g), key=lambda r: r.k)] == list(range(150))


def plain_metrics(rows):
    p = 1 / (1 + np.exp(-np.array([r[3] for r in rows])))
    y = np.array([[x in r[2] for x in LABELS] for r in rows])
    top = np.zeros_like(y)
    top[np.arange(len(rows)), p.argmax(1)] = True
    f1 = lambda a: np.array([2 * (a[:, i] & y[:, i]).sum() / max(1, a[:, i].sum() + y[:, i].sum()) for i in range(9)])
    micro = lambda a: 2 * (a & y).sum() / max(1, a.sum() + y.sum())
    return p, y, top, f1, micro


def test_metrics_thresholds_confusion(spark):
    rows = rows_of(200)
    df = frame(spark, rows)
    scores = evaluation.label_scores(df)
    means = {(r.eval_set, r.family): (r.macro_f1, r.micro_f1) for r in evaluation.averages(scores).collect()}
    gaps = {r.eval_set: r for r in evaluation.probability_gap(df).collect()}
    best = {(r.eval_set, r.label): (r.threshold, r.f1) for r in evaluation.best_thresholds(df).collect()}
    conf = {(r.eval_set, r.true_label, r.pred_label): r.n for r in evaluation.confusion(df).collect()}
    for s in "ab":
        p, y, top, f1, micro = plain_metrics([r for r in rows if r[1] == s])
        for family, pred in (("threshold", p >= 0.5), ("argmax", top)):
            assert means[s, family] == (pytest.approx(f1(pred).mean()), pytest.approx(micro(pred)))
        assert gaps[s].prob_gap == pytest.approx(p[y].mean() - p[~y].mean())
        grid = np.arange(0.05, 0.95, 0.02)
        for i, label in enumerate(LABELS):
            if not y[:, i].any():
                assert best[s, label] == (0.5, None)
                continue
            all_f1 = [2 * ((p[:, i] >= t) & y[:, i]).sum() / ((p[:, i] >= t).sum() + y[:, i].sum()) for t in grid]
            assert best[s, label] == (pytest.approx(grid[int(np.argmax(all_f1))]), pytest.approx(max(all_f1)))
        want = Counter((LABELS[t], LABELS[q]) for t, q in zip(y.argmax(1), p.argmax(1), strict=True))
        assert all(conf[s, a, b] == want[a, b] for a in LABELS for b in LABELS) and sum(want.values()) == 100
    assert evaluation.confusion_table(evaluation.confusion(df)).count() == 18
    support = {(r.eval_set, r.label): r.n_true for r in scores.where("family = 'argmax'").collect()}
    assert support["a", LABELS[0]] == sum(LABELS[0] in r[2] for r in rows if r[1] == "a")


def test_benchmark_and_tuned(spark):
    df = frame(spark, rows_of(120))
    tuned = evaluation.best_thresholds(df, keys=()).select("label_id", "threshold")
    got = {(r.eval_set, r.family, r.label, r.metric): r.value for r in evaluation.benchmark(df, tuned).collect()}
    assert {k[1] for k in got} == {"threshold", "argmax", "tuned", "self_tuned", "probability"}
    assert got["a", "self_tuned", None, "macro_f1"] >= got["a", "threshold", None, "macro_f1"]
    assert len(got) == 2 * (4 * (27 + 2) + 3)
    assert evaluation.label_scores(frame(spark, [])).count() == 0


def test_best_epoch_and_compare(spark):
    h = spark.createDataFrame([(1, 0.2, 0.3, 9.0), (2, 0.6, 0.1, 8.0), (3, 0.4, 0.6, 7.0)], "epoch int, argmax_macro_f1 double, macro_f1 double, train_loss double")
    assert tuple(evaluation.best_epoch(h).first()) == (2, 0.6)
    assert evaluation.without_run_columns(h).columns == ["argmax_macro_f1", "macro_f1"]
    m = spark.createDataFrame([("x", 1, "e1", 0.5), ("y", 2, "e1", 0.7), ("z", 3, "e1", None), ("x", 1, "e2", 0.5), ("y", 2, "e3", 0.5), ("x", 1, "e3", 0.5005), ("x", 1, "e4", 0.9), ("z", 3, "e4", 0.2)], "model string, pos int, eval_set string, value double")
    got = {r.eval_set: (r.last_model, r.delta if r.delta is None else round(r.delta, 6), r.arrow) for r in evaluation.compare(m).collect()}
    assert got == {"e1": ("y", 0.2, "↑"), "e2": ("x", None, None), "e3": ("y", -0.0005, "·"), "e4": ("z", -0.7, "↓")}
    assert {r.model: round(r.value, 4) for r in evaluation.mean_over_sets(m).collect()} == {"x": 0.6001, "y": 0.6, "z": 0.2}
    wide = {r.eval_set: (r.x, r.y, r.z) for r in evaluation.side_by_side(m, ["x", "y", "z"]).collect()}
    assert wide["e2"] == (0.5, None, None)


def test_agreement(spark):
    rng = random.Random(1)
    rows = [(i, rng.sample(LABELS[:4], rng.choice([0, 1, 2])), rng.sample(LABELS[:4], 1), rng.choice(["hoog", "laag", None]), rng.choice(["x", " ", None])) for i in range(200)]
    sheet = spark.createDataFrame(rows, "id int, labels_a array<string>, labels_b array<string>, confidence_a string, notes_a string")
    for r in agreement.by_label(sheet).collect():
        a, b = np.array([r.label in x[1] for x in rows]), np.array([r.label in x[2] for x in rows])
        seen, chance = (a == b).mean(), a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
        assert r.kappa == pytest.approx(1.0 if chance == 1 else (seen - chance) / (1 - chance))
        assert r.flagged == (r.kappa < 0.75 or r.f1 < 0.7)
    for r in agreement.rule_breaks(agreement.route_disagreement(sheet)).collect():
        n = len(set(r.labels_a) ^ set(r.labels_b))
        assert (r.n_differences, r.route) == (n, {0: "accept", 1: "reviewer"}.get(n, "discussion"))
        assert ("note_missing" in r.breaks) == (r.confidence_a == "laag" and not (r.notes_a or "").strip()) and ("labels_missing" in r.breaks) == (not r.labels_a)
    rare = spark.createDataFrame([(["bezwaar", "zienswijze"],), (["bezwaar"],), (None,)], "l array<string>").select(agreement.has_rare_pair(F.col("l")))
    assert [r[0] for r in rare.collect()] == [True, False, False]
    routed = spark.createDataFrame([("klacht", "klacht"), ("klacht", "melding")], "true_label string, pred_label string")
    assert tuple(agreement.route_score(routed).first()) == (2, 1, 0.5)


def letters(n, seed=0):
    rng = random.Random(seed)
    words = {"klacht": "boos traag balie fout", "bezwaar": "besluit oneens herzien afwijzing", "melding": "open start adres vanaf"}
    out = []
    for i in range(n):
        label = rng.choice(list(words))
        out.append((i, " ".join(rng.choice(words[label].split() + ["de", "het", "een"]) for _ in range(12)), [label], "e"))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    cols = "id int, text string, labels array<string>, eval_set string"
    make = lambda n, s: spark.createDataFrame(letters(n, s), cols)
    model, history = classifier.choose(make(150, 1), make(60, 2), [{"reg": 0.01}, {"reg": 1.0}], max_iter=25, features=256)
    return model, history, make


def test_model_learns_and_reports(spark, trained):
    model, history, make = trained
    assert set(model.heads) == {"klacht", "bezwaar", "melding"} and history.count() == 2
    report = {(r.family, r.label, r.metric): r.value for r in classifier.tune_and_report(model, make(60, 2), make(60, 3)).collect()}
    assert report["argmax", "klacht", "f1"] > 0.9 and report["tuned", "bezwaar", "f1"] > 0.9
    assert len(classifier.loss_history(model)) > 6
    odd = model.score(spark.createDataFrame([(1, None), (2, "")], "id int, text string")).collect()
    assert [len(r.logits) for r in odd] == [9, 9] and odd[0].text is None


def test_streams(spark, tmp_path, trained):
    src = f"{tmp_path}/in"
    rows = spark.createDataFrame([("a", "x@y.nl", "2024-01-01 00:00:00"), ("a", "x@y.nl", "2024-01-01 00:05:00"), ("b", "dag", "2024-01-01 00:01:00")], "id string, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(src)
    new = lambda: jobs.first_seen(jobs.read_landing(spark, src, rows.schema), "id", "ts")
    jobs.collect_new(new(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    rows.withColumn("id", F.when(F.col("id") == "b", "c").otherwise(F.col("id"))).write.mode("append").parquet(src)
    jobs.collect_new(new(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    jobs.redact_stream(jobs.read_landing(spark, src, rows.schema), f"{tmp_path}/red", f"{tmp_path}/aud", f"{tmp_path}/ck2").awaitTermination()
    kept = sinks.read_redacted(spark, f"{tmp_path}/red", "id string, text string")
    assert {r.text for r in kept.collect()} == {"[EMAIL]", "dag"} and sinks.read_audit(spark, f"{tmp_path}/red", f"{tmp_path}/aud", "record_id string").count() == 4
    q = jobs.score_stream(jobs.read_landing(spark, src, rows.schema), trained[0]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").count() == 6
    seen, obs = jobs.observed(rows, "progress", mail=F.col("text").contains("@"))
    seen.write.format("noop").mode("overwrite").save()
    assert obs.get == {"total": 3, "mail": 2}


def test_gold_and_losses(spark):
    p = spark.createDataFrame([(1, [0.5]), (2, [0.1])], "id int, logits array<double>")
    g = spark.createDataFrame([(1, ["klacht"]), (3, [])], "id int, labels array<string>")
    assert [(r.id, r.labels) for r in evaluation.attach_gold(p, g).collect()] == [(1, ["klacht"])]
    steps = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "epoch int, loss double")
    assert {(r.epoch, r.train_loss) for r in evaluation.loss_by_epoch(steps).collect()} == {(1, 3.0), (2, 1.0)}
