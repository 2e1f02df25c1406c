"""Registered queries of file round trips, page limits, run records and observed counts, and of harder letters and rulings.

Files are written to the shared folder and read back, so the rows show what a reader of the files gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import labels as L
from lettermill.functions import quotes
from lettermill.functions import text as T
from lettermill.functions.storage import new_path
from lettermill.operators import datasets, evaluation, prompts, redaction
from lettermill.queries import _CELLS, _EXAMPLES_SQL, _FAMILIES, _LINES, _dealt, _rounded, _split_sql, letters, query, ruling_rows, scored, table
from lettermill.sources import examples, paging, rulings, sinks

# ---------------------------------------------------------------- harder letters and rulings

#: Phones of every kind, a spaced IBAN, an e-mail address that holds a citizen number, a postcode that takes a phone's first digits, null and empty letters.
_HARD = """
SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Brief ', cast(c_custkey AS string), ': ', CASE c_custkey % 8
  WHEN 2 THEN 'ik woon op 1234 AB 06-12345678' WHEN 3 THEN 'bel +31 6 12345678' WHEN 4 THEN 'bel 0031-20-1234567' WHEN 5 THEN 'bel 0800-1234'
  WHEN 6 THEN 'rekening NL91 ABNA 0417 1643 00' ELSE 'mail 111222333@x.nl of 111222333' END, ' graag.') END AS text
FROM customer
"""


@query(
    """
SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Brief ' || c_custkey || ': ' || CASE c_custkey % 8
    WHEN 2 THEN 'ik woon op [POSTCODE]-12345678' WHEN 6 THEN 'rekening [IBAN]' WHEN 7 THEN 'mail [EMAIL] of [BSN]' ELSE 'bel [TELEFOON]' END || ' graag.' END AS text,
  CASE WHEN c_custkey % 8 < 2 THEN 0 WHEN c_custkey % 8 = 7 THEN 2 ELSE 1 END AS n_spans, c_custkey % 8 > 1 AS pseudonymized
FROM customer
"""
)
def pii_hard_letters(spark, sf_dir):
    """Overlapping spans: the first by place and the longest stay, and a citizen number inside another span is none."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return redaction.pseudonymize(spark.sql(_HARD)).select("id", "text", F.size("spans").alias("n_spans"), "pseudonymized")


_B1 = "concat('ons huis staat leeg omdat de weg voor de deur al maanden dicht is ', cast(o_orderkey AS string))"
_B2 = "concat('wij willen dat de gemeente die weg zo snel als het kan weer opent ', cast(o_orderkey AS string))"
_QUOTE_FORMS = f"""
SELECT o_orderkey AS k, CASE o_orderkey % 5
  WHEN 0 THEN concat('Appellant heeft aangevoerd: »', {_B1}, '« en stelt verder: "', {_B2}, '".')
  WHEN 1 THEN concat('Klaagster heeft verklaard: “', {_B1}, '”.') WHEN 2 THEN concat('De indiener schrijft „ ', {_B2}, ' ” aan ons.')
  WHEN 3 THEN concat('Appellant. "', {_B1}, '"') ELSE 'Appellant stelt: "te kort".' END AS full_text
FROM orders
"""
_B1_SQL, _B2_SQL = (x.replace("AS string", "AS varchar") for x in (_B1, _B2))


@query(
    f"""
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN {_B1_SQL} || '|' || {_B2_SQL} WHEN 1 THEN {_B1_SQL} WHEN 2 THEN {_B2_SQL} ELSE '' END AS quotes,
  CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n FROM orders
"""
)
def quote_forms(spark, sf_dir):
    """Several quotes in a ruling, every kind of mark, quotes without a verb before them, and short ones."""
    _dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").createOrReplaceTempView("orders")
    found = spark.sql(_QUOTE_FORMS).withColumn("c", quotes.extract(F.col("full_text")))
    return found.select("k", F.array_join(F.transform("c", lambda c: c["quote"]), "|").alias("quotes"), F.size("c").alias("n"))


@query(
    """
SELECT o_orderkey AS ecli, CASE o_orderkey % 4 WHEN 0 THEN 'Hof' WHEN 1 THEN NULL WHEN 2 THEN 'Rechtbank' END AS instance,
  CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::DATE::VARCHAR END AS decision_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'Een twee drie art. 6:4a Awb.' WHEN 1 THEN 'Artikel 3:15 en artikel 3:15 Awb ' || o_orderkey WHEN 2 THEN NULL END AS full_text,
  CASE o_orderkey % 4 WHEN 1 THEN '3:15' ELSE '' END AS articles
FROM orders
"""
)
def ruling_xml_forms(spark, sf_dir):
    """Mixed content, bodies without a name space, dates with a time, blank fields, no body and no XML."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    head = lambda creator, time: F.concat(F.lit(f"<r><creator>{creator}</creator><date>"), day, F.lit(f"{time}</date>"))
    mixed = F.concat(head("Hof", ""), F.lit("<uitspraak><para>Een <em>twee</em>\n drie</para> art. 6:4a Awb.</uitspraak></r>"))
    blank = F.concat(head(" ", "T10:00:00"), F.lit('<uitspraak xmlns="urn:x">Artikel 3:15 en artikel 3:15 Awb '), k.cast("string"), F.lit("</uitspraak></r>"))
    none = F.concat(head("Rechtbank", " "), F.lit("</r>"))
    xml = F.when(k % 4 == 0, mixed).when(k % 4 == 1, blank).when(k % 4 == 2, none).otherwise(F.when(k % 8 == 3, ""))
    parsed = rulings.parse_rulings(_dealt(orders, "o_orderkey").select(k.alias("ecli"), xml.alias("xml")))
    return parsed.select("ecli", "instance", F.col("decision_date").cast("string").alias("decision_date"), "full_text", F.array_join("awb_articles_cited", ",").alias("articles"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND o_orderkey % 3 <> 0")
def rulings_with_content(spark, sf_dir):
    rows = ruling_rows(spark, sf_dir).withColumn("full_text", F.when(F.col("k") % 3 != 0, F.col("full_text")))
    return rulings.with_content(rows, "1995-01-01", "1996-12-31").select("k")


@query("SELECT o_orderkey AS k FROM orders")
def rulings_kept_whole(spark, sf_dir):
    """With keep_all, rulings without a signal stay, too."""
    return rulings.relevant(rulings.with_signals(ruling_rows(spark, sf_dir)), keep_all=True).select("k")


@query("SELECT conv_id, turn FROM conversations QUALIFY turn < min(turn) OVER (PARTITION BY conv_id) + 2")
def page_limit(spark, sf_dir):
    """A conversation is a feed and each turn a page of it; two pages of each are read."""
    return paging.first_pages(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 2, "turn", ("conv_id",))


# ---------------------------------------------------------------- files written and read back


@query("SELECT doc_id, 2 AS n_appended, 1 AS n_overwritten FROM documents")
def sink_append_and_overwrite(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "sink")
    for _ in range(2):
        sinks.append_rows(docs, f"{out}/appended")
        sinks.overwrite_rows(docs, f"{out}/overwritten")
    back = spark.read.schema("doc_id long, text string").json([f"{out}/appended", f"{out}/overwritten"])
    times = lambda folder: F.count_if(F.col("_metadata.file_path").contains(f"/{folder}/")).cast("int").alias(f"n_{folder}")
    return back.groupBy("doc_id").agg(times("appended"), times("overwritten"))


@query(f"WITH {_split_sql('SELECT doc_id AS id, 1 AS bucket FROM documents', '0.7::DOUBLE', '0.15::DOUBLE')} SELECT id, split FROM split")
def sink_splits(spark, sf_dir):
    """One folder a split; the folder's name is the split when read back."""
    out = new_path(spark, "splits")
    sinks.save_splits(datasets.random_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), out)
    return spark.read.schema("id long, text string, split string").json(out).select("id", "split")


@query(
    """
SELECT c_custkey AS id, 2 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + bsn::INT AS n_audited, 2 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + bsn::INT AS n_placeholders
FROM (SELECT c_custkey, list_sum(list_transform(range(1, 10), lambda i: substr((100000000 + c_custkey * 7919)::VARCHAR, i, 1)::INT * [9, 8, 7, 6, 5, 4, 3, 2, -1][i])) % 11 = 0 AS bsn FROM customer)
"""
)
def sink_redacted(spark, sf_dir):
    """Redacted letters and the audit lie in two folders; each replacement is in both."""
    done, out = redaction.pseudonymize(letters(spark, sf_dir)), new_path(spark, "redacted")
    sinks.save_redacted(done.drop("spans"), redaction.audit(done), f"{out}/text", f"{out}/audit")
    text = sinks.read_redacted(spark, f"{out}/text", "id long, text string").select("id", F.regexp_count("text", F.lit(r"\[(BSN|EMAIL|IBAN|POSTCODE|TELEFOON)\]")).alias("n_placeholders"))
    audited = sinks.read_audit(spark, f"{out}/text", f"{out}/audit", "record_id string").groupBy(F.col("record_id").cast("long").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n_audited"))
    return text.join(audited, "id", "left").select("id", F.coalesce("n_audited", F.lit(0)).alias("n_audited"), "n_placeholders")


@query(f"WITH {_CELLS}, {_FAMILIES} SELECT eval_set, family, 'macro_f1' AS metric, round(avg(f1), 6) AS value FROM sc GROUP BY ALL")
def report_round_trip(spark, sf_dir):
    """A benchmark report as one JSON document, scanned for its metrics again; run columns are dropped before."""
    means = evaluation.averages(evaluation.label_scores(scored(spark, sf_dir))).withColumn("epoch", F.lit(3))
    means = evaluation.without_run_columns(_rounded(means)).select("eval_set", "family", F.create_map(F.lit("macro_f1"), "macro_f1").alias("m"))
    sets = means.groupBy("eval_set").agg(F.map_from_entries(F.collect_list(F.struct("family", "m"))).alias("families"))
    out = new_path(spark, "report")
    sinks.save_report(sets.agg(F.map_from_entries(F.collect_list(F.struct("eval_set", "families"))).alias("evaluations")), out)
    return sinks.read_reports(spark, out).drop("path")


@query(
    """
SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS folder, 'brief' AS text, 'gold' AS source,
  CASE doc_id % 4 WHEN 0 THEN '000110000' WHEN 2 THEN '000000000' ELSE '001000000' END AS hot
FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 1 AND doc_id % 11 <> 0
"""
)
def examples_from_files(spark, sf_dir):
    """Labelled lines of two folders as one set with the folder of each row, and as training rows."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    lines, out = spark.sql(_LINES), new_path(spark, "examples")
    for rest, folder in enumerate(("even", "odd")):
        lines.where(F.col("doc_id") % 2 == rest).select("value").write.text(f"{out}/{folder}")
    kept, _ = examples.read_examples(spark, f"{out}/even", f"{out}/odd")
    folders = kept.select("id", T.parent_folder(F.col("file_path")).alias("folder"))
    rows = examples.training_rows(kept).select("id", "text", "source", F.array_join(F.transform("labels", lambda x: x.cast("int").cast("string")), "").alias("hot"))
    return rows.join(folders, "id").select("id", "folder", "text", "source", "hot")


# ---------------------------------------------------------------- checks, run records, prompts, counts


@query("SELECT c_custkey FROM customer")
def domain_check(spark, sf_dir):
    """Customers whose nation is in the dimension; one outside of it would be an error."""
    return datasets.domain_check(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey").select("c_custkey")


@query("SELECT o_custkey AS epoch, avg(round(o_totalprice * 100)) AS train_loss FROM orders GROUP BY o_custkey")
def training_loss_by_epoch(spark, sf_dir):
    """Orders stand for steps, customers for epochs. Whole cents have the same mean in any order of addition."""
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("epoch"), F.round(F.col("o_totalprice") * 100).alias("loss"))
    return evaluation.loss_by_epoch(steps)


@query(f"WITH {_EXAMPLES_SQL} SELECT id, array_to_string(labels, ',') AS labels, round(logits[1], 6) AS first_logit FROM ex WHERE id % 3 <> 0 AND id % 2 = 0")
def attach_gold_labels(spark, sf_dir):
    """Scores of two thirds of the rows meet the labels of the even ones."""
    rows = scored(spark, sf_dir)
    joined = evaluation.attach_gold(rows.where("id % 3 <> 0").select("id", "logits"), rows.where("id % 2 = 0").select("id", "labels"))
    return joined.select("id", F.array_join("labels", ",").alias("labels"), F.round(F.get("logits", F.lit(0)), 6).alias("first_logit"))


_COMBO_ROWS = ", ".join("([{}])".format(", ".join(f"'{x}'" for x in labels)) for labels, _ in prompts.COMBOS)
_DEFINITIONS = ", ".join(f"('{k}', '{d}')" for k, (d, _, _) in prompts.LABEL_PROMPTS.items())
_COMBO_STYLE_ROWS = ", ".join(f"('{s}', '{prompts.STYLES[s]}')" for s in prompts.COMBO_STYLES)


@query(
    f"""
WITH co AS (SELECT row_number() OVER () - 1 AS i, c AS labels FROM (VALUES {_COMBO_ROWS}) t(c)), lb(label, definition) AS (VALUES {_DEFINITIONS}), st(style, style_text) AS (VALUES {_COMBO_STYLE_ROWS}),
f AS (SELECT conv_id, text, labels FROM conversations JOIN co ON conv_id % {len(prompts.COMBOS)} = i WHERE turn = 0),
d AS (SELECT conv_id, any_value(text) AS text, string_agg('- ' || label || ': ' || definition, chr(10) ORDER BY j) AS lines
  FROM (SELECT conv_id, text, unnest(labels) AS label, generate_subscripts(labels, 1) AS j FROM f) JOIN lb USING (label) GROUP BY conv_id)
SELECT conv_id, style, repeat, md5('Je schrijft als inwoner aan de gemeente. Stijl: ' || style_text || '. Geef alleen de brief.') AS system_md5,
  md5('Soorten:' || chr(10) || lines || chr(10) || 'Opdracht: ' || text) AS user_md5
FROM d CROSS JOIN st CROSS JOIN range(1, 3) r(repeat)
"""
)
def prompt_combos(spark, sf_dir):
    """Every first turn is the instruction for a letter with two labels, in each style for such letters, twice."""
    pairs = F.array(*[F.array(*[F.lit(x) for x in labels]) for labels, _ in prompts.COMBOS])
    first = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.get(pairs, (F.col("conv_id") % len(prompts.COMBOS)).cast("int")).alias("labels"), F.col("text").alias("instruction"))
    styles = prompts.style_table(spark).where(F.col("style").isin(*prompts.COMBO_STYLES))
    cells = prompts.combo_grid(first, styles, prompts.label_table(spark), 2)
    md5 = lambda i: F.md5(F.col("messages")[i]["content"].cast("binary"))
    return cells.select("conv_id", "style", F.col("repeat").cast("long").alias("repeat"), md5(0).alias("system_md5"), md5(1).alias("user_md5"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large FROM events")
def stream_observed_counts(spark, sf_dir):
    """Counts that a stream of events reports of itself while it is written, summed over its batches."""
    from lettermill.streaming import jobs

    out = new_path(spark, "stream")
    landed = jobs.read_landing(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)

    def write(batch: DataFrame, number: int) -> None:
        counted, seen = jobs.observed(batch, f"batch{number}", clicks=F.col("event_type") == "click", large=F.col("value") > 50)
        counted.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        batch.sparkSession.createDataFrame([{k: int(v) for k, v in seen.get.items()}], "total long, clicks long, large long").write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    landed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts").agg(*[F.sum(c).alias(c) for c in ("total", "clicks", "large")])
