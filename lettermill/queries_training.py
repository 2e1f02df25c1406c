"""Registered queries of training, choice, tuning and scoring, with SQL that trains the same model.

The SQL unrolls the optimizer: a common table expression for the logits and one for the weights of
each iteration. Term buckets, weights, scores, thresholds and metrics all follow from the tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import labels as L
from lettermill.functions.storage import new_path
from lettermill.operators import datasets
from lettermill.plans import classifier
from lettermill.queries import _COUNTS, _FAMILIES, _RAREST, _THRESHOLDS, _TUNED, _rounded, _split_sql, query, table
from lettermill.sources import sinks

#: The nine classes take the place of the table's two: quality as aanvraag, toxic as klacht.
HEADS = {"quality": "aanvraag", "toxic": "klacht"}
ITERATIONS, REGS = 8, (0.01, 0.1)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, labels): documents with a row of labels."""
    found = F.array_compact(F.array(*[F.when(F.col(c) == 1, label) for c, label in HEADS.items()]))
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), found.alias("labels"))
    return gold.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


_LABELLED = "ex AS MATERIALIZED (SELECT doc_id AS id, text, list_filter([{}], lambda n: n IS NOT NULL) AS labels FROM labels JOIN documents USING (doc_id))".format(
    ", ".join(f"CASE WHEN {c} = 1 THEN '{label}' END" for c, label in HEADS.items())
)
_CLASSES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(L.LABELS))


def _training_sql(train: str, settings: list[tuple[str, int, float]], iterations: int) -> str:
    """Tables x (id, b, v), o<k> (objectives) and zf (id, h, z) for heads (label, setting, reg), trained on the ids of `train`."""
    heads = ", ".join(f"({h}, '{label}', {e}, {reg!r}::DOUBLE)" for h, (label, e, reg) in enumerate(settings))
    sql = rf"""
bits(b, c, k) AS MATERIALIZED (
  SELECT range, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 0 FROM range(256)
), crcs AS MATERIALIZED (SELECT list(c ORDER BY b) AS crc FROM bits
), train AS MATERIALIZED ({train}
), words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM ex
), vocab AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT)),
                            lambda c, x: xor(c // 256, crc[(xor(c, x) % 256 + 1)::INT])), 4294967295::BIGINT) % {classifier.FEATURES} AS b
  FROM (SELECT DISTINCT w FROM words), crcs
), term_counts AS MATERIALIZED (SELECT id, b, count(*) AS tf FROM words JOIN vocab USING (w) GROUP BY ALL
), tn AS (SELECT count(*) AS n FROM train
), idf AS MATERIALIZED (SELECT b, ln((n + 1)::DOUBLE / (df + 1)) AS idf FROM (SELECT b, count(*) AS df FROM term_counts SEMI JOIN train USING (id) GROUP BY b), tn
), raw AS (SELECT id, b, tf * coalesce(idf, ln((n + 1)::DOUBLE)) AS v FROM term_counts LEFT JOIN idf USING (b), tn
), x AS MATERIALIZED (
  SELECT id, b, CASE WHEN s > 0 THEN v / s ELSE 0 END AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS s FROM raw) UNION ALL SELECT id, {classifier.CONSTANT}, 1.0::DOUBLE FROM ex
), xt AS MATERIALIZED (SELECT x.* FROM x SEMI JOIN train USING (id)
), hd(h, label, e, reg) AS (VALUES {heads}
), y AS MATERIALIZED (
  SELECT id, h, list_contains(labels, label)::INT AS y, CASE WHEN list_contains(labels, label) THEN {classifier.POSITIVE_WEIGHT!r}::DOUBLE ELSE 1.0::DOUBLE END AS cw FROM ex SEMI JOIN train USING (id) CROSS JOIN hd
), sz AS MATERIALIZED (SELECT h, sum(cw) AS size FROM y GROUP BY h
), b0 AS MATERIALIZED (SELECT h, reg, b, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (SELECT DISTINCT b FROM xt) CROSS JOIN hd)"""
    t = 1.0
    for k in range(iterations):
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        sql += f"""
, z{k} AS MATERIALIZED (SELECT id, h, y, cw, z, cw / size * (1 / (1 + exp(-z)) - y) AS r FROM (SELECT id, h, sum(xt.v * b.v) AS z FROM xt JOIN b{k} b USING (b) GROUP BY id, h) JOIN y USING (id, h) JOIN sz USING (h)
), o{k} AS (
  SELECT h, {k} AS iteration, loss / size + reg / 2 * squares AS objective FROM (SELECT h, sum(cw * ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))) AS loss FROM z{k} GROUP BY h)
  JOIN (SELECT h, reg, sum(v * v) FILTER (WHERE b >= 0) AS squares FROM b{k} GROUP BY ALL) USING (h) JOIN sz USING (h)
), b{k + 1} AS MATERIALIZED (
  SELECT h, reg, b, nw AS w, nw + {(t - 1) / t_next!r}::DOUBLE * (nw - w) AS v
  FROM (SELECT b.h, b.reg, b.b, b.w, b.v - (g + CASE WHEN b.b >= 0 THEN b.reg * b.v ELSE 0 END) / (0.5 + b.reg) AS nw FROM b{k} b JOIN (SELECT h, b, sum(r * xt.v) AS g FROM xt JOIN z{k} USING (id) GROUP BY h, b) USING (h, b))
)"""
        t = t_next
    return sql + f", zf AS MATERIALIZED (SELECT id, h, sum(x.v * b.w) AS z FROM x JOIN b{iterations} b USING (b) GROUP BY id, h)"


_ONE = [(label, 0, 0.01) for label in HEADS.values()]
_GRID = [(label, e, reg) for e, reg in enumerate(REGS) for label in HEADS.values()]
_ALL_SQL = f"WITH {_LABELLED}, {_training_sql('SELECT id FROM ex', _ONE, ITERATIONS)}"


@query(f"{_ALL_SQL} SELECT label, b::INT AS bucket, round(w, 6) AS weight FROM b{ITERATIONS} JOIN hd USING (h)")
def trained_weights(spark, sf_dir):
    """The model itself: weights of all heads by term bucket, trained together on all labelled documents."""
    model = classifier.train(labelled_documents(spark, sf_dir), max_iter=ITERATIONS)
    return _rounded(classifier.weight_table(model, spark))


@query(f"{_ALL_SQL}, o AS ({' UNION ALL '.join(f'SELECT * FROM o{k}' for k in range(ITERATIONS))}) SELECT label, iteration::INT AS iteration, round(objective, 6) AS objective FROM o JOIN hd USING (h)")
def training_history(spark, sf_dir):
    """The objective of each head before each iteration."""
    model = classifier.train(labelled_documents(spark, sf_dir), max_iter=ITERATIONS)
    return _rounded(spark.createDataFrame(classifier.loss_history(model), "label string, iteration int, objective double"))


_CHOICE = f"""
WITH {_LABELLED}, {_COUNTS}, {_split_sql(_RAREST, '0.7::DOUBLE', '0.15::DOUBLE')}, {_training_sql("SELECT id FROM split WHERE split = 'train'", _GRID, ITERATIONS)},
cls(label_id, label) AS (VALUES {_CLASSES}), es(e) AS (VALUES (0), (1)),
pe AS MATERIALIZED (
  SELECT e, id, split AS eval_set, label_id, label, 1 / (1 + exp(-coalesce(z, {classifier.NO_HEAD!r}::DOUBLE))) AS p, list_contains(labels, label)::INT AS y
  FROM ex JOIN split USING (id) CROSS JOIN cls CROSS JOIN es LEFT JOIN (SELECT id, label, e, z FROM zf JOIN hd USING (h)) USING (id, label, e) WHERE split <> 'train'
), every_cell AS (SELECT *, (row_number() OVER (PARTITION BY e, id ORDER BY p DESC, label_id) = 1)::INT AS top FROM pe
), f1s AS (
  SELECT e, label_id, 2.0::DOUBLE * sum((p >= 0.5)::INT * y) / nullif(sum((p >= 0.5)::INT) + sum(y), 0) AS at_half, 2.0::DOUBLE * sum(top * y) / nullif(sum(top) + sum(y), 0) AS at_top FROM every_cell WHERE eval_set = 'val' GROUP BY ALL
), runs AS (SELECT e, avg(coalesce(at_top, 0)) AS argmax_macro_f1, avg(coalesce(at_half, 0)) AS macro_f1 FROM f1s GROUP BY e
), cells AS (SELECT * EXCLUDE (e) FROM every_cell WHERE e = (SELECT e FROM runs ORDER BY greatest(argmax_macro_f1, macro_f1) DESC, e LIMIT 1))"""


def _split(spark: SparkSession, sf_dir: str):
    rows = datasets.stratified_split(labelled_documents(spark, sf_dir)).persist()
    return lambda name: rows.where(F.col("split") == name).withColumn("eval_set", F.lit(name))


@query(f"{_CHOICE} SELECT e::INT AS epoch, round(argmax_macro_f1, 6) AS argmax_macro_f1, round(macro_f1, 6) AS macro_f1 FROM runs")
def choice_of_settings(spark, sf_dir):
    """Validation scores of each setting of a grid, trained in the same passes and scored in one."""
    part = _split(spark, sf_dir)
    return _rounded(classifier.choose(part("train"), part("val"), [{"reg": r} for r in REGS], max_iter=ITERATIONS)[1])


_REPORT = f"""{_CHOICE}, {_FAMILIES}, {_THRESHOLDS}, {_TUNED},
vt AS (SELECT c.label_id, c.label, sum(y)::BIGINT AS n_true, sum((p >= threshold)::INT)::BIGINT AS n_pred, sum((p >= threshold)::INT * y)::BIGINT AS tp FROM cells c JOIN best b ON b.eval_set = 'val' AND b.label_id = c.label_id WHERE c.eval_set = 'test' GROUP BY ALL),
vs AS (SELECT label, CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END AS precision, CASE WHEN n_true = 0 THEN 0 ELSE tp / n_true END AS recall, CASE WHEN n_pred + n_true = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_true) END AS f1, tp, n_pred, n_true FROM vt),
rep AS (
  SELECT * FROM long WHERE eval_set = 'test'
  UNION ALL SELECT 'test', 'tuned', label, 'precision', precision FROM vs UNION ALL SELECT 'test', 'tuned', label, 'recall', recall FROM vs UNION ALL SELECT 'test', 'tuned', label, 'f1', f1 FROM vs
  UNION ALL SELECT 'test', 'tuned', NULL, 'macro_f1', avg(f1) FROM vs
  UNION ALL SELECT 'test', 'tuned', NULL, 'micro_f1', CASE WHEN sum(n_pred + n_true) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(tp) / sum(n_pred + n_true) END FROM vs
)"""


@query(f"{_REPORT} SELECT eval_set, family, label, metric, round(value, 6) AS value FROM rep")
def train_and_benchmark(spark, sf_dir):
    """Split, train all settings together, choose one and its thresholds on val, report on test."""
    part = _split(spark, sf_dir)
    model, _ = classifier.choose(part("train"), part("val"), [{"reg": r} for r in REGS], max_iter=ITERATIONS)
    return _rounded(classifier.tune_and_report(model, part("val"), part("test")))


@query(
    f"""{_REPORT}
SELECT eval_set, family, CASE WHEN label IS NULL THEN metric ELSE metric || '_per_label' END AS metric, label, round(value, 6) AS value FROM rep
UNION ALL SELECT 'test', 'tuned', 'threshold_per_label', label, round(threshold, 6) FROM best WHERE eval_set = 'val'"""
)
def training_run_report(spark, sf_dir):
    """A run written as one step (model, losses, scores of the settings, report), and its report read back value by value."""
    part, out = _split(spark, sf_dir), new_path(spark, "run")
    model, runs = classifier.choose(part("train"), part("val"), [{"reg": r} for r in REGS], max_iter=ITERATIONS)
    classifier.save_run(model, runs, part("val"), part("test"), out)
    return _rounded(sinks.read_report_values(spark, f"{out}/report").drop("path", "text"))


_HALF_SQL = f"WITH {_LABELLED}, {_training_sql('SELECT id FROM ex WHERE id % 2 = 0', _ONE, ITERATIONS)}"


@query(
    f"""{_HALF_SQL}, cls(label_id, label) AS (VALUES {_CLASSES}),
p AS (SELECT ex.id, label, label_id, 1 / (1 + exp(-coalesce(z, {classifier.NO_HEAD!r}::DOUBLE))) AS p FROM ex CROSS JOIN cls LEFT JOIN (SELECT id, label, z FROM zf JOIN hd USING (h)) USING (id, label) WHERE trim(text) <> '')
SELECT id, label AS top_label, round(p, 6) AS top_score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, label_id) = 1"""
)
def stream_scores(spark, sf_dir):
    """A classifier trained on one half of the labelled documents, saved and read again, scores all of them as they land."""
    from lettermill.streaming import jobs

    out = new_path(spark, "stream")
    labelled_documents(spark, sf_dir).write.parquet(f"{out}/in")
    rows = spark.read.parquet(f"{out}/in")
    classifier.save(classifier.train(rows.where("id % 2 = 0"), max_iter=ITERATIONS), spark, f"{out}/model")
    landed = jobs.read_landing(spark, f"{out}/in", rows.schema)
    scores = jobs.score_stream(landed, classifier.load(spark, f"{out}/model")).select("id", "top_label", "top_score")
    jobs.collect_new(scores, f"{out}/scores", f"{out}/state").awaitTermination()
    return _rounded(spark.read.parquet(f"{out}/scores"))
