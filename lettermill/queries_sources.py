"""Registered queries of paged feeds, resumable collection, commits, nested reports, segments and samples by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.storage import cut, new_path
from lettermill.operators import datasets, evaluation, phrases
from lettermill.queries import _CELLS, _EXAMPLES_SQL, _FAMILIES, _THRESHOLDS, _XML_SPARK, _dealt, _rounded, query, scored, table
from lettermill.sources import catalog, paged, rulings, sinks
from lettermill.streaming import jobs

PAGE_ROWS = 50

# ---------------------------------------------------------------- paged feeds


def _catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, value): parts as catalog pages of PAGE_ROWS datasets; every 29th page has no success."""
    part = table(spark, sf_dir, "part")
    page_no = F.floor(F.col("p_partkey") / PAGE_ROWS).cast("int")
    dataset = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    rows = part.select(page_no.alias("page_no"), dataset.alias("d")).groupBy("page_no").agg(F.array_sort(F.collect_list("d")).alias("results"))
    return rows.select("page_no", F.to_json(F.struct((F.col("page_no") % 29 != 28).alias("success"), F.struct("results").alias("result"))).alias("value"))


def _land(pages: DataFrame, path: str) -> None:
    """A file a page, written by all cores; tasks move their own files into place, where the driver would move them one by one."""
    dealt = _dealt(pages, "page_no").write.mode("append").partitionBy("page_no")
    dealt.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


_PAGED = f"SELECT p_partkey, (p_partkey // {PAGE_ROWS})::INT AS page_no FROM part"


@query(f"SELECT p_partkey::VARCHAR AS id, page_no FROM ({_PAGED}) WHERE page_no < 28")
def paged_collection(spark, sf_dir):
    """A landed feed read page by page in parallel, up to where a collector stops: before the first page without success."""
    out = f"{new_path(spark, 'pages')}/catalog"
    _land(_catalog_pages(spark, sf_dir), out)
    paged.register(spark)
    body = F.from_json("body", catalog.PAGE)
    ids = F.when(body["success"], F.transform(body["result"]["results"], lambda d: d["id"]))
    # the files are read once, for the rules that stop a collector and for the rows
    pages = cut(spark.read.format("pages").load(out).select("feed", "page_no", ids.alias("ids")))
    kept = paged.reached(pages, F.col("ids"), PAGE_ROWS)
    return kept.select(F.explode("ids").alias("id"), "page_no")


@query(f"SELECT p_partkey::VARCHAR AS id FROM ({_PAGED}) WHERE page_no BETWEEN 2 AND 6")
def paged_limits(spark, sf_dir):
    """Bounds on page numbers choose which pages are read at all."""
    out = f"{new_path(spark, 'pages')}/catalog"
    _land(_catalog_pages(spark, sf_dir), out)
    paged.register(spark)
    pages = spark.read.format("pages").option("pages_a_partition", 2).load(out).where("page_no >= 2 AND page_no < 7")
    return catalog.datasets(pages.select(F.col("body").alias("page"))).select("id")


@query(f"SELECT p_partkey::VARCHAR AS id, CASE WHEN page_no < 9 THEN 'first' ELSE 'second' END AS run FROM ({_PAGED}) WHERE page_no % 29 <> 28")
def paged_stream_resume(spark, sf_dir):
    """Two runs over a feed that grows between them: the second begins at the first page it has not read; page 9 lands late."""
    out = new_path(spark, "pages")
    paged.register(spark)
    pages = _catalog_pages(spark, sf_dir)
    steps = (("first", pages.where("page_no < 9 OR page_no BETWEEN 10 AND 15")), ("second", pages.where("page_no = 9 OR page_no > 15")))
    for run, landing in steps:
        _land(landing, f"{out}/catalog")
        stream = spark.readStream.format("pages").load(f"{out}/catalog")
        found = catalog.datasets(stream.select(F.col("body").alias("page"))).select("id", F.lit(run).alias("run"))
        jobs.collect_unseen(found, "id", f"{out}/rows", f"{out}/state").awaitTermination()
    return jobs.collected(spark, f"{out}/rows", "id string, run string")


@query(
    """
WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS part FROM events), f AS (SELECT user_id, min(part) AS part FROM e GROUP BY user_id)
SELECT e.user_id, e.part AS run, e.event_id FROM e JOIN f USING (user_id, part) QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1
"""
)
def stream_resume(spark, sf_dir):
    """Users collected by three runs: a part of the events, the rest, and all again after the checkpoint was lost. No user twice."""
    out, events = new_path(spark, "stream"), table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    part = F.when(F.col("event_id") % 3 == 0, 1).otherwise(2)
    for run, state in ((1, "state"), (2, "state"), (3, "new-state")):
        if run < 3:
            events.where(part == run).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{out}/landed")
        landed = jobs.read_landing(spark, f"{out}/landed", "user_id long, event_id long, ts timestamp_ntz, run int")
        jobs.collect_unseen(landed, "user_id", f"{out}/rows", f"{out}/{state}", ("ts", "event_id")).awaitTermination()
    return jobs.collected(spark, f"{out}/rows", "user_id long, event_id long, ts timestamp_ntz, run int").select("user_id", "run", "event_id")


# ---------------------------------------------------------------- commits


@query("SELECT doc_id, 1 AS n FROM documents")
def sink_append_once(spark, sf_dir):
    """A batch that is written twice is there once, and what a failed write left is not seen."""
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "once")
    for key, rest in (("batch-0", 0), ("batch-1", 1), ("batch-0", 0)):
        sinks.append_once(docs.where(F.col("doc_id") % 2 == rest), out, key)
    docs.limit(3).write.json(f"{out}/rows/batch-2-failed")
    return sinks.read_appended(spark, out, "doc_id long, text string").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


# ---------------------------------------------------------------- reports


@query(
    f"""
WITH {_CELLS}, {_FAMILIES}, {_THRESHOLDS}
SELECT eval_set, family, metric, label, round(value, 6) AS value, text FROM (
  SELECT eval_set, family, 'macro_f1' AS metric, NULL AS label, avg(f1) AS value, NULL AS text FROM sc GROUP BY ALL
  UNION ALL SELECT eval_set, family, 'f1_per_label', label, f1, NULL FROM sc
  UNION ALL SELECT eval_set, 'self_tuned', 'thresholds_per_label', label, threshold, NULL FROM best
  UNION ALL SELECT eval_set, family, 'model', NULL, NULL, 'model ' || family FROM sc GROUP BY ALL)
"""
)
def report_per_label(spark, sf_dir):
    """A benchmark report with tables by label and texts, as one JSON document, read back value by value."""
    rows = scored(spark, sf_dir)
    scores = _rounded(evaluation.label_scores(rows))
    means = _rounded(evaluation.averages(scores))
    per_label = scores.groupBy("eval_set", "family").agg(F.map_from_entries(F.collect_list(F.struct("label", "f1"))).alias("f1_per_label"))
    body = F.to_json(F.struct("macro_f1", "f1_per_label", F.concat(F.lit("model "), "family").alias("model")))
    families = means.join(per_label, ["eval_set", "family"]).select("eval_set", "family", body.alias("body"))
    best = _rounded(evaluation.best_thresholds(rows)).groupBy("eval_set").agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("thresholds_per_label"))
    families = families.unionByName(best.select("eval_set", F.lit("self_tuned").alias("family"), F.to_json(F.struct("thresholds_per_label")).alias("body")))
    sets = families.groupBy("eval_set").agg(F.map_from_entries(F.collect_list(F.struct("family", F.parse_json("body")))).alias("families"))
    out = new_path(spark, "report")
    sinks.save_report(sets.agg(F.map_from_entries(F.collect_list(F.struct("eval_set", "families"))).alias("evaluations")), out)
    back = sinks.read_report_values(spark, out)
    return _rounded(back.select("eval_set", "family", "metric", "label", "value", F.when(F.col("value").isNull(), F.col("text")).alias("text")))


_SEGMENTS = """SELECT *, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, (id % 3)::INT AS third FROM cells"""


@query(
    f"""
WITH {_CELLS}, s AS ({_SEGMENTS}), c AS (
  SELECT eval_set, label, parity, third, concat_ws(',', CASE WHEN grouping(parity) = 0 THEN 'parity' END, CASE WHEN grouping(third) = 0 THEN 'third' END) AS level, t AS threshold,
    sum(y)::BIGINT AS n_true, sum((p >= t)::INT)::BIGINT AS n_pred, sum((p >= t)::INT * y)::BIGINT AS tp
  FROM s CROSS JOIN (VALUES (0.5::DOUBLE), (0.7::DOUBLE)) v(t) GROUP BY GROUPING SETS ((eval_set, label, t), (eval_set, label, t, parity), (eval_set, label, t, third), (eval_set, label, t, parity, third))
)
SELECT *, round(CASE WHEN n_pred + n_true = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_true) END, 6) AS f1 FROM c
"""
)
def segment_levels(spark, sf_dir):
    """Scores of the whole sets, by each segment column and by both, at two thresholds, in one pass; one column has nulls."""
    parity = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, "even").otherwise("odd")
    rows = scored(spark, sf_dir).withColumns({"parity": parity, "third": (F.col("id") % 3).cast("int")})
    found = evaluation.segment_scores(rows, ((), ("parity",), ("third",), ("parity", "third")), (0.5, 0.7))
    return _rounded(found.select("eval_set", "label", "parity", "third", "level", "threshold", "n_true", "n_pred", "tp", "f1"))


@query(
    f"""
WITH {_EXAMPLES_SQL}, l AS (SELECT id, unnest(CASE WHEN len(labels) = 0 THEN ['{datasets.NONE}'] ELSE list_distinct(labels) END) AS label FROM ex)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id)::INT AS nth, id FROM l QUALIFY nth <= 20
"""
)
def sample_by_label(spark, sf_dir):
    """Twenty examples of each label for a check by hand, rare labels included."""
    return datasets.sample_by_label(scored(spark, sf_dir), 20).select("label", "nth", "id")


# ---------------------------------------------------------------- large feeds and many phrases

_NAMESPACES = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:psi="http://psi.rechtspraak.nl/" xmlns:rs="http://www.rechtspraak.nl/schema/rechtspraak-1.0"'


@query(
    """
SELECT 'ECLI:NL:RVS:2024:' || o_orderkey AS ecli, o_orderdate::DATE::VARCHAR AS decision_date, o_orderkey || '/A1' AS case_number, CASE WHEN o_orderkey % 2 = 0 THEN 'kort' ELSE 'inhoud' END AS summary,
  'Volgens artikel 6:5 van de Awb (' || o_orderkey || ').' AS full_text, '6:5' AS articles
FROM orders WHERE o_orderkey % 9 <> 0
"""
)
def ruling_feed_file(spark, sf_dir):
    """All rulings as one XML document that declares its name spaces once, written and read by many tasks; every ninth is not closed.

    The document lies in part files, as parallel writers leave it: in the order of their names the root's
    opening, the rulings and the root's end. No task holds, sorts or writes all of it.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    _dealt(orders, "o_orderkey").createOrReplaceTempView("orders")
    named = F.replace("xml", F.lit("<rdf:Description>"), F.concat(F.lit("<rdf:Description><dcterms:identifier>"), "ecli", F.lit("</dcterms:identifier>")))
    lines = spark.sql(_XML_SPARK).select(F.replace(named, F.lit(f" {_NAMESPACES}"), F.lit("")).alias("value"))
    end = lambda tag: spark.range(1, numPartitions=1).select(F.lit(tag).alias("value"))
    out = new_path(spark, "feed")
    end(f"<feed {_NAMESPACES}>").union(lines).union(end("</feed>")).write.text(out)
    parsed = rulings.parse_rulings(rulings.read_feed_records(spark, out, declarations=_NAMESPACES))
    return parsed.select("ecli", F.col("decision_date").cast("string").alias("decision_date"), "case_number", "summary", "full_text", F.array_join("awb_articles_cited", ",").alias("articles"))


_PHRASE_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(
    rf"""
WITH p AS (SELECT DISTINCT array_to_string(w[1:item_id % 3 + 2], ' ') AS phrase, len(w[1:item_id % 3 + 2]) AS m FROM (SELECT item_id, {_PHRASE_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT doc_id, {_PHRASE_WORDS} AS w FROM documents), r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM d CROSS JOIN (VALUES (2), (3), (4)) v(m))
SELECT doc_id AS id, phrase, count(*) AS n FROM r SEMI JOIN p USING (phrase) GROUP BY ALL
"""
)
def phrase_counts(spark, sf_dir):
    """The first words of every benchmark item, counted in all documents at once."""
    first = phrases.words(F.col("text"))
    table_of = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(first, 1, (F.col("item_id") % 3 + 2).cast("int")), " ").alias("phrase"))
    return phrases.phrase_counts(table(spark, sf_dir, "documents"), table_of, "doc_id")
