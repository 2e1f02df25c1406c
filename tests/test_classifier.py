"""The joint optimizer against closed forms, a plain optimizer and Spark's own regression; the model apart from the session."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.plans import classifier
from lettermill.streaming import jobs

COLS = "id int, text string, labels array<string>"
WORDS = "boos balie besluit oneens straat lamp graag dank fout kosten".split()


def make(spark, n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice(["klacht", "bezwaar", "melding"])
        own = {"klacht": WORDS[:2], "bezwaar": WORDS[2:4], "melding": WORDS[4:6]}[label]
        rows.append((i, " ".join(rng.choice(own + WORDS[6:]) for _ in range(rng.randint(1, 12))), [label] + ["beroep"] * (i % 5 == 0)))
    rows += [(n, None, ["klacht"]), (n + 1, "", None), (n + 2, "boos", []), (n + 3, "boos", ["unheard-of"]), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, COLS)


def test_constant_of_texts_without_words_has_a_closed_form(spark):
    rows = spark.createDataFrame([(i, "", ["klacht"] if i < 3 else []) for i in range(20)], COLS)
    model = classifier.train(rows, positive_weight=4.0, max_iter=200, features=16)
    assert model.heads == ["klacht"] and not model.weights[:-1].any()
    assert model.weights[-1, 0] == pytest.approx(math.log(4.0 * 3 / 17), abs=1e-6)
    logits = model.score(rows).first().logits
    assert logits[3] == pytest.approx(math.log(12 / 17), abs=1e-6) and logits[0] == classifier.NO_HEAD


def dense(rows, features, n_docs, idf):
    x = np.zeros((n_docs, features + 1))
    for i, r in enumerate(rows):
        for b in r.terms:
            x[i, b] += 1
    x[:, :-1] *= idf
    norm = np.sqrt((x[:, :-1] ** 2).sum(axis=1, keepdims=True))
    x[:, :-1] = np.divide(x[:, :-1], norm, out=np.zeros_like(x[:, :-1]), where=norm > 0)
    x[:, -1] = 1
    return x


def test_weights_are_the_minimum_of_the_penalised_loss(spark):
    df, features, reg = make(spark, 120).repartition(5), 64, 0.05
    model = classifier.train(df, reg=reg, max_iter=300, features=features)
    rows = df.select(classifier.term_buckets(F.col("text"), features).alias("terms"), "labels").collect()
    x = dense(rows, features, len(rows), model.idf)
    for h, label in enumerate(model.heads):
        y = np.array([label in (r.labels or []) for r in rows], dtype=float)
        c = np.where(y == 1, classifier.POSITIVE_WEIGHT, 1.0)
        w = model.weights[:, h]
        gradient = (c * (1 / (1 + np.exp(-x @ w)) - y)) @ x / c.sum()
        gradient[:-1] += reg * w[:-1]
        assert abs(gradient).max() < 1e-5, label
    assert set(model.heads) == {"klacht", "bezwaar", "melding", "beroep"}
    losses = [v for label, _, v in model.history if label == "klacht"]
    assert losses[0] == pytest.approx(math.log(2)) and losses[-1] < losses[0] and len(losses) == 300


def test_agrees_with_sparks_own_regression(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    df, features = make(spark, 80, 3), 32
    model = classifier.train(df, reg=0.02, max_iter=300, features=features)
    rows = df.select(classifier.term_buckets(F.col("text"), features).alias("terms"), "labels").collect()
    x = dense(rows, features, len(rows), model.idf)[:, :-1]
    data = [(Vectors.dense(v), float("klacht" in (r.labels or [])), 8.0 if "klacht" in (r.labels or []) else 1.0) for v, r in zip(x, rows, strict=True)]
    from pyspark.sql.types import DoubleType, StructField, StructType

    table = spark.createDataFrame(data, StructType([StructField("f", VectorUDT()), StructField("y", DoubleType()), StructField("w", DoubleType())]))
    other = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.02, standardization=False, maxIter=300, tol=1e-10).fit(table)
    h = model.heads.index("klacht")
    assert model.weights[:-1, h] == pytest.approx(other.coefficients.toArray(), abs=2e-4) and model.weights[-1, h] == pytest.approx(other.intercept, abs=2e-4)


def test_settings_trained_together_are_those_trained_apart(spark, monkeypatch):
    df = make(spark, 60, 1).repartition(7)
    both = classifier.train_grid(df, [{"reg": 0.01}, {"reg": 0.5, "positive_weight": 2.0}], max_iter=8, features=64)
    monkeypatch.setattr(classifier, "FAN", 2)  # sums in several levels
    monkeypatch.setattr(classifier, "BLOCK_ROWS", 3)
    for together, setting in zip(both, ({"reg": 0.01}, {"reg": 0.5, "positive_weight": 2.0}), strict=True):
        alone = classifier.train(df, max_iter=8, features=64, **setting)
        assert alone.heads == together.heads and np.allclose(alone.weights, together.weights, atol=1e-12) and np.allclose([v for *_, v in alone.history], [v for *_, v in together.history])


def test_scores_after_the_session_has_observed(spark, tmp_path):
    df = make(spark, 50, 2)
    model = classifier.train(df, max_iter=5, features=64)
    before = {r.id: r.logits for r in model.score(df).collect()}
    seen, _ = jobs.observed(df, "rows-of-a-session")
    seen.collect()
    assert {r.id: r.logits for r in model.score(df).collect()} == before
    again = classifier.train(df, max_iter=5, features=64)
    assert np.allclose(again.weights, model.weights)
    classifier.save(model, spark, f"{tmp_path}/model")
    stored = classifier.load(spark, f"{tmp_path}/model")
    assert {r.id: r.logits for r in stored.score(df).collect()} == before and stored.heads == model.heads
    table = {(r.label, r.bucket): r.weight for r in classifier.weight_table(model, spark).collect()}
    assert table["klacht", classifier.CONSTANT] == model.weights[-1, model.heads.index("klacht")] and len(table) == np.count_nonzero(model.weights)


def test_nothing_to_learn_from(spark):
    none = make(spark, 5).limit(0)
    model = classifier.train(none, features=16)
    assert list(model.heads) == [] and model.history == []
    assert model.score(make(spark, 3)).select("logits").distinct().collect()[0].logits == [classifier.NO_HEAD] * 9
    one_sided = spark.createDataFrame([(1, "a", ["klacht"]), (2, "b", ["klacht"])], COLS)
    assert list(classifier.train(one_sided, features=16).heads) == []
    clash = spark.createDataFrame([("x", "boos", 1, "k")], "logits string, text string, terms int, y string")
    scored = classifier.train(make(spark, 30), max_iter=2, features=16).score(clash)
    assert scored.columns == clash.columns and len(scored.first().logits) == 9


def test_parts_of_the_training_table_grow_in_number_not_in_size(spark, monkeypatch):
    """A table in one partition is dealt into parts of a bounded number of terms, with the same model."""
    df = spark.createDataFrame([(i, f"woord{i % 7} brief{i % 5} " * 10, ["klacht"] if i % 3 else []) for i in range(300)], "id int, text string, labels array<string>").coalesce(1)
    whole = classifier.train(df, max_iter=3, features=64)
    parts = []
    blocks = classifier._blocks
    monkeypatch.setattr(classifier, "PART_TERMS", 500)
    monkeypatch.setattr(classifier, "_blocks", lambda rows, idf: parts.extend(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.size("terms")).alias("n")).collect()) or blocks(rows, idf))
    dealt = classifier.train(df, max_iter=3, features=64)
    assert sum(parts) == 6000 and len(parts) >= 12 and max(parts) <= 1000
    assert np.allclose(whole.weights, dealt.weights, atol=1e-12)
