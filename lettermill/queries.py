"""Registered queries of the library's own operators, each with the same result in DuckDB SQL where possible.

The driver's tables hold no Dutch letters, rulings or scores, so these are derived from them row by
row, alike in both engines: letters from customers, rulings from orders, scored examples from
embeddings, catalog and council pages from parts and orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import labels as L
from lettermill.functions import pii, quotes
from lettermill.functions import text as T
from lettermill.functions.storage import new_path
from lettermill.operators import agreement, candidates, datasets, evaluation, prompts, redaction
from lettermill.sources import catalog, council, examples, rulings, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small scan dealt to all cores, before long texts are derived from them."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


# ---------------------------------------------------------------- personal data

_EMAIL_SQL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


_AREAS_SQL = f"(?:{pii.AREA_CODES})"
_PHONE_SQL = rf"(?:(?:\+31|0031)\s?-?\s?(?:6\s?-?\s?[0-9]{{8}}|{_AREAS_SQL}\s?-?\s?[0-9]{{6,7}})|06\s?-?\s?[0-9]{{8}}|0{_AREAS_SQL}\s?-?\s?[0-9]{{6,7}}|0(?:800|900)\s?-?\s?[0-9]{{4,7}})"
_NINE_SQL = " + ".join(f"{w} * x[{i + 1}]::INT" for i, w in enumerate(pii.BSN_WEIGHTS))
#: Counts of each kind, where no two spans overlap.
_KINDS_SQL = rf"""
len(regexp_extract_all(text, '\b{_EMAIL_SQL}'))
+ len(regexp_extract_all(text, '(?:^|\W){_PHONE_SQL}(?:$|\W)'))
+ len(regexp_extract_all(text, '\b[0-9]{{4}}\s?[A-Z]{{2}}(?:\s+[0-9]{{1,5}}[a-zA-Z]?)?\b'))
+ len(list_filter(regexp_extract_all(text, '\b[0-9]{{9}}\b'), lambda x: ({_NINE_SQL}) % 11 = 0))
+ len(list_filter(list_transform(regexp_extract_all(text, '(?i)\bNL[0-9]{{2}}\s?[A-Z]{{4}}(?:\s?[0-9]{{4}}){{2}}\s?[0-9]{{2}}\b'), lambda x: upper(regexp_replace(x, '\s', '', 'g'))),
    lambda x: list_reduce(list_prepend(0, list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
      lambda r, d: CASE WHEN d > 9 THEN (r * 100 + d) % 97 ELSE (r * 10 + d) % 97 END) = 1))"""


@query(
    f"""
SELECT lang, count(*) AS records, count(*) FILTER (WHERE n > 0) AS redacted_records, coalesce(sum(n), 0)::BIGINT AS redactions
FROM (SELECT lang, coalesce({_KINDS_SQL}, 0) AS n FROM documents) GROUP BY lang
"""
)
def pii_stats_by_language(spark, sf_dir):
    """Flagship: personal data of all five kinds in all documents, counted by language."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    # only spans are counted, so the text itself is not rewritten
    return redaction.stats(redaction.with_spans(docs), ("lang",))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '\b{_EMAIL_SQL}', '[EMAIL]', 'g')) AS text_md5 FROM documents")
def pii_redact_emails(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(pii.redact(F.col("text"), pii.find_emails(F.col("text"))).cast("binary")).alias("text_md5"))


#: A letter for each customer, in words that both engines read: parts end in '. ', so no two spans touch.
_BSN = "cast(100000000 + c_custkey * 7919 AS string)"
_BANK = "'ABNA'"
_LETTERS = rf"""
SELECT c_custkey AS id, concat('Mijn nummer is ', {_BSN}, '. Ik woon op ', cast(1000 + c_custkey % 9000 AS string),
  CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END, 'AB ', cast(c_custkey % 90 + 1 AS string), '. Bel 06-', lpad(cast(10000000 + c_custkey AS string), 8, '0'),
  CASE WHEN c_custkey % 3 = 0 THEN concat('. Mail burger', cast(c_custkey AS string), '@voorbeeld.nl. ') ELSE '. ' END,
  'Rekening NL', lpad(cast((98 - (cast(concat('10112310', lpad(cast(c_custkey AS string), 10, '0'), '232100') AS decimal(38,0)) % 97) + c_custkey % 2) AS string), 2, '0'),
  'ABNA', lpad(cast(c_custkey AS string), 10, '0'), '.') AS text
FROM customer
"""
_LETTERS_SQL = _LETTERS.replace("AS string)", "AS varchar)").replace("decimal(38,0)", "hugeint")
_DIGIT_SUM = " + ".join(f"{w} * substr({_BSN.replace('AS string', 'AS varchar')}, {i + 1}, 1)::INT" for i, w in enumerate(pii.BSN_WEIGHTS))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_LETTERS)


#: Pieces of a letter by arithmetic: what must be found in it.
_TRUTH = rf"""
letters AS ({_LETTERS_SQL}),
truth AS (
  SELECT c_custkey AS id, text, ({_DIGIT_SUM}) % 11 = 0 AS bsn, c_custkey % 2 = 0 AS iban, c_custkey % 3 = 0 AS email,
         substr(text, 16, 9) AS bsn_text, regexp_extract(text, 'NL[0-9]{{2}}ABNA[0-9]{{10}}') AS iban_text
  FROM customer JOIN letters ON id = c_custkey
)"""
_REDACTED_SQL = r"""regexp_replace(regexp_replace(regexp_replace(
    CASE WHEN bsn THEN replace(body, bsn_text, '[BSN]') ELSE body END,
    '[0-9]{4} ?AB [0-9]+', '[POSTCODE]'), '06-[0-9]{8}', '[TELEFOON]'), 'burger[0-9]+@voorbeeld.nl', '[EMAIL]')"""


@query(
    f"""
WITH {_TRUTH}, b AS (SELECT *, CASE WHEN iban THEN replace(text, iban_text, '[IBAN]') ELSE text END AS body FROM truth)
SELECT id, {_REDACTED_SQL} AS text, 2 + bsn::INT + iban::INT + email::INT AS n_spans, true AS pseudonymized FROM b
"""
)
def pii_pseudonymize_letters(spark, sf_dir):
    return redaction.pseudonymize(letters(spark, sf_dir)).select("id", "text", F.size("spans").alias("n_spans"), "pseudonymized")


@query(
    f"""
WITH {_TRUTH}
SELECT 'BSN' AS pattern, count(*) FILTER (WHERE bsn) AS n FROM truth UNION ALL SELECT 'EMAIL', count(*) FILTER (WHERE email) FROM truth
UNION ALL SELECT 'IBAN', count(*) FILTER (WHERE iban) FROM truth UNION ALL SELECT 'POSTCODE', count(*) FROM truth UNION ALL SELECT 'TELEFOON', count(*) FROM truth
"""
)
def pii_pattern_counts(spark, sf_dir):
    return redaction.pattern_counts(redaction.with_spans(letters(spark, sf_dir)))


@query(
    f"""
WITH {_TRUTH}, s AS (
  SELECT id, text, 'BSN' AS pattern, bsn_text AS original FROM truth WHERE bsn
  UNION ALL SELECT id, text, 'IBAN', iban_text FROM truth WHERE iban
  UNION ALL SELECT id, text, 'EMAIL', regexp_extract(text, 'burger[0-9]+@voorbeeld.nl') FROM truth WHERE email
  UNION ALL SELECT id, text, 'POSTCODE', regexp_extract(text, '[0-9]{{4}} ?AB [0-9]+') FROM truth
  UNION ALL SELECT id, text, 'TELEFOON', regexp_extract(text, '06-[0-9]{{8}}') FROM truth
)
SELECT id::VARCHAR AS record_id, pattern, original, '[' || pattern || ']' AS placeholder, (strpos(text, original) - 1)::INT AS "start", (strpos(text, original) - 1 + length(original))::INT AS "end" FROM s
"""
)
def pii_audit(spark, sf_dir):
    return redaction.audit(redaction.with_spans(letters(spark, sf_dir)))


@query(
    f"""
WITH {_TRUTH}
SELECT id, bsn AS bsn_valid, iban AS iban_valid FROM truth
"""
)
def pii_check_digits(spark, sf_dir):
    rows = letters(spark, sf_dir)
    iban = F.regexp_extract("text", "NL[0-9]{2}ABNA[0-9]{10}", 0)
    return rows.select("id", pii.is_valid_bsn(F.substring("text", 16, 9)).alias("bsn_valid"), pii.is_valid_iban_nl(iban).alias("iban_valid"))


# ---------------------------------------------------------------- rulings and quotes

_ARTICLES = (*T.ARTICLE_LABELS, "2:1")
_ARTICLE_LIST = ", ".join(f"'{a}'" for a in _ARTICLES)
_RULINGS = f"""
SELECT o_orderkey AS k, concat('ECLI:NL:RVS:2024:', cast(o_orderkey AS string)) AS ecli, cast(o_orderdate AS date) AS decision_date, o_orderpriority AS subject,
  concat('De zaak ', cast(o_orderkey AS string), '. ', CASE WHEN o_orderkey % 7 = 0 THEN 'Iemand' ELSE 'Eiseres' END, ' heeft in haar brief het volgende aangevoerd: "',
    CASE WHEN o_orderkey % 11 = 0 THEN 'Te kort.' ELSE concat('Geachte heer, ik ben het niet eens met het besluit over mijn tuin, want ons pad is weg',
      repeat(' en de weg is dicht', cast(o_orderkey % 30 AS int)), CASE WHEN o_orderkey % 5 = 0 THEN ' zegt de rechtbank' ELSE '' END, '.') END,
    '" Zie artikel ', element_at(array({_ARTICLE_LIST}), cast(o_orderkey % {len(_ARTICLES)} AS int) + 1), ' Awb',
    CASE WHEN o_orderkey % 13 = 0 THEN ' en de Wet open overheid.' ELSE '.' END) AS full_text
FROM orders
"""
_RULINGS_SQL = _RULINGS.replace("AS string)", "AS varchar)").replace("element_at(array(", "list_extract(list_value(")


def ruling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    _dealt(orders, "o_orderkey").createOrReplaceTempView("orders")
    return spark.sql(_RULINGS)


@query(
    f"""
WITH r AS ({_RULINGS_SQL})
SELECT ecli, CASE WHEN k % {len(_ARTICLES)} = {len(_ARTICLES) - 1} THEN '' ELSE ([{_ARTICLE_LIST}])[(k % {len(_ARTICLES)} + 1)::INT] END AS articles,
       k % 13 = 0 AS woo_cited FROM r WHERE k % {len(_ARTICLES)} <> {len(_ARTICLES) - 1} OR k % 13 = 0
"""
)
def ruling_signals(spark, sf_dir):
    found = rulings.relevant(rulings.with_signals(ruling_rows(spark, sf_dir)))
    return found.select("ecli", F.array_join("awb_articles_cited", ",").alias("articles"), "woo_cited")


_ARTICLE_HINTS = "MAP {" + ", ".join(f"'{a}': '{','.join(ls)}'" for a, ls in T.ARTICLE_LABELS.items()) + "}"


@query(f"WITH r AS ({_RULINGS_SQL}) SELECT label, count(*) AS n FROM (SELECT ({_ARTICLE_HINTS})[regexp_extract(full_text, 'artikel ([0-9]+:[0-9]+)', 1)] AS label FROM r) WHERE label IS NOT NULL GROUP BY label")
def article_labels(spark, sf_dir):
    found = rulings.with_signals(ruling_rows(spark, sf_dir)).select(T.labels_of_articles(F.col("awb_articles_cited")).alias("labels"))
    return datasets.label_distribution(found)


def quote_candidates_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ruling_rows(spark, sf_dir).withColumns({"content_url": F.lit(None).cast("string"), "instance": F.lit(None).cast("string")})
    return candidates.candidates(rows)


_HINTS = "MAP {" + ", ".join(f"'{a}': '{label}'" for a, label in quotes.SUGGESTS.items()) + "}"
_CANDIDATES_SQL = f"""
r AS ({_RULINGS_SQL}),
q AS (
  SELECT *, regexp_extract(full_text, '"([^"]*)"', 1) AS quote, strpos(full_text, '"') - 1 AS spot, regexp_extract(full_text, 'artikel ([0-9]+:[0-9]+)', 1) AS article
  FROM r WHERE k % 7 <> 0 AND k % 11 <> 0
), s AS (
  SELECT *, length(quote) AS n, ({_HINTS})[article] AS hint,
    (0.5::DOUBLE - 0.15::DOUBLE * (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)
      + least(0.3::DOUBLE, 0.05::DOUBLE * len(regexp_extract_all(quote, '(?i)\\b(ik|mijn|mij|me|wij|ons|onze)\\b')))
      + CASE WHEN length(quote) BETWEEN 100 AND 500 THEN 0.2::DOUBLE WHEN length(quote) BETWEEN 80 AND 800 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE) AS score
  FROM q
), c AS (
  SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)), 3) AS quality_score,
    CASE WHEN hint IS NULL THEN '' ELSE hint END || CASE WHEN woo THEN CASE WHEN hint IS NULL THEN 'woo_verzoek' ELSE ',woo_verzoek' END ELSE '' END AS suggested
  FROM (SELECT *, regexp_matches(substr(full_text, spot + n + 3, 200), 'Wet open overheid') AS woo FROM s) WHERE n BETWEEN 80 AND 2000
)"""


@query(
    f"""
WITH {_CANDIDATES_SQL}
SELECT 'rcs-' || substr(md5(ecli || '|' || spot), 1, 10) AS id, ecli, quote, spot::INT AS quote_start_in_text, suggested AS suggested_labels, quality_score,
  CASE WHEN hint IS NULL AND NOT woo THEN 'geen specifiek signaal' ELSE coalesce('art ' || CASE WHEN hint IS NOT NULL THEN article END, '') || CASE WHEN woo THEN CASE WHEN hint IS NULL THEN 'Woo-referentie' ELSE '; Woo-referentie' END ELSE '' END END AS suggestion_reason
FROM c
"""
)
def quote_candidates(spark, sf_dir):
    return quote_candidates_df(spark, sf_dir).select("id", "ecli", "quote", "quote_start_in_text", F.array_join("suggested_labels", ",").alias("suggested_labels"), "quality_score", "suggestion_reason")


@query(
    f"""
WITH {_CANDIDATES_SQL}
SELECT CASE WHEN quality_score >= 0.8 THEN '0.8+' WHEN quality_score >= 0.6 THEN '0.6-0.8' ELSE '0.4-0.6' END AS band, count(*) AS n FROM c GROUP BY 1
"""
)
def candidate_score_bands(spark, sf_dir):
    return candidates.score_bands(quote_candidates_df(spark, sf_dir))


@query(
    f"""
WITH {_CANDIDATES_SQL}
SELECT label, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN suggested = '' THEN '__geen_suggestie__' ELSE suggested END, ',')) AS label FROM c) GROUP BY label
"""
)
def candidate_suggestions(spark, sf_dir):
    return candidates.suggestion_counts(quote_candidates_df(spark, sf_dir))


@query(
    f"""
WITH {_CANDIDATES_SQL}
SELECT 'rcs-' || substr(md5(ecli || '|' || spot), 1, 10) AS id, quality_score FROM c ORDER BY quality_score DESC, id LIMIT 100
"""
)
def candidates_for_review(spark, sf_dir):
    return candidates.for_review(quote_candidates_df(spark, sf_dir), 100).select("id", "quality_score")


_XML_SPARK = """
SELECT o_orderkey AS k, concat('ECLI:NL:RVS:2024:', cast(o_orderkey AS string)) AS ecli,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('<open-rechtspraak><uitspraak>kapot ', cast(o_orderkey AS string)) ELSE
  concat('<open-rechtspraak xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:psi="http://psi.rechtspraak.nl/" xmlns:rs="http://www.rechtspraak.nl/schema/rechtspraak-1.0"><rdf:RDF><rdf:Description>',
    '<dcterms:creator> Raad van State </dcterms:creator><dcterms:date>', date_format(cast(o_orderdate AS date), 'yyyy-MM-dd'), '</dcterms:date><dcterms:subject>', o_orderpriority, '</dcterms:subject>',
    '<psi:zaaknummer>', cast(o_orderkey AS string), '/A1</psi:zaaknummer>', CASE WHEN o_orderkey % 2 = 0 THEN '<dcterms:abstract>kort</dcterms:abstract>' ELSE '' END,
    '</rdf:Description></rdf:RDF><rs:inhoudsindicatie>inhoud</rs:inhoudsindicatie><rs:uitspraak><parablock><para>Volgens  artikel 6:5</para><para>van de Awb (', cast(o_orderkey AS string), ').</para></parablock></rs:uitspraak></open-rechtspraak>') END AS xml
FROM orders
"""


@query(
    """
SELECT 'ECLI:NL:RVS:2024:' || o_orderkey AS ecli, CASE WHEN ok THEN 'Raad van State' END AS instance, CASE WHEN ok THEN o_orderdate::DATE::VARCHAR END AS decision_date,
  CASE WHEN ok THEN o_orderpriority END AS subject, CASE WHEN ok THEN o_orderkey || '/A1' END AS case_number,
  CASE WHEN ok THEN CASE WHEN o_orderkey % 2 = 0 THEN 'kort' ELSE 'inhoud' END END AS summary,
  CASE WHEN ok THEN 'Volgens artikel 6:5 van de Awb (' || o_orderkey || ').' END AS full_text, CASE WHEN ok THEN '6:5' ELSE '' END AS articles, false AS woo_cited
FROM (SELECT *, o_orderkey % 9 <> 0 AS ok FROM orders)
"""
)
def ruling_xml(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    _dealt(orders, "o_orderkey").createOrReplaceTempView("orders")
    parsed = rulings.parse_rulings(spark.sql(_XML_SPARK))
    return parsed.select("ecli", "instance", F.col("decision_date").cast("string").alias("decision_date"), "subject", "case_number", "summary", "full_text", F.array_join("awb_articles_cited", ",").alias("articles"), "woo_cited")


@query("SELECT DISTINCT 'ECLI:' || o_custkey AS ecli FROM orders WHERE o_orderkey % 4 <> 0")
def feed_identifiers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    entry = F.concat(F.lit("<entry><id> ECLI:"), F.col("o_custkey").cast("string"), F.lit(" </id></entry><entry><id> </id></entry>"))
    page = F.when(F.col("o_orderkey") % 4 == 0, F.lit("<feed><entry>")).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry, F.lit("</feed>")))
    return rulings.feed_ids(orders.select(page.alias("xml")))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def resume_unseen(spark, sf_dir):
    seen = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return datasets.unseen(table(spark, sf_dir, "orders").select("o_custkey"), seen, "o_custkey")


# ---------------------------------------------------------------- catalog and council pages

_FORMATS = "'JSON', ' csv ', 'PDF', 'GeoJSON', '', 'xlsx'"
_FORMAT_AT = "element_at(array({f}), cast(p_partkey % 6 AS int) + 1)"


@query(
    rf"""
WITH p AS (SELECT *, ([{_FORMATS}])[(p_partkey % 6 + 1)::INT] AS f FROM part WHERE p_partkey % 8 <> 0)
SELECT p_partkey::VARCHAR AS id, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'Gemeente ' || p_brand END AS organization, substr(repeat(p_name || ' ', 40), 1, 300) AS notes_excerpt,
  2 AS n_resources_total, (lower(trim(f)) IN ('json', 'csv', 'geojson'))::INT + 1 AS n_resources_machine_readable,
  array_to_string(list_sort(list_distinct([lower(f), 'xml'])), '|') AS all_resource_formats
FROM p
"""
)
def catalog_summaries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("JSON", " csv ", "PDF", "GeoJSON", "", "xlsx")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    org = F.struct(F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("Gemeente "), "p_brand")).alias("title"), F.col("p_brand").alias("name"))
    resource = lambda f: F.struct(f.alias("format"), F.lit("http://x").alias("url"), F.lit("n").alias("name"))
    dataset = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), org.alias("organization"), F.repeat(F.concat("p_name", F.lit(" ")), 40).alias("notes"), F.array(resource(kind), resource(F.lit("XML"))).alias("resources"))
    page = F.to_json(F.struct((F.col("p_partkey") % 8 != 0).alias("success"), F.struct(F.array(dataset).alias("results")).alias("result")))
    found = catalog.summarize(catalog.datasets(part.select(page.alias("page"))))
    return found.select("id", "title", "organization", "notes_excerpt", "n_resources_total", "n_resources_machine_readable", F.array_join("all_resource_formats", "|").alias("all_resource_formats"))


@query(
    """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Ingekomen brief over ' ELSE 'Agenda ' END || o_orderpriority AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Brief_' ELSE 'stuk_' END || o_orderkey || '.pdf' AS file_name,
  repeat('tekst ', (o_orderkey % 50)::INT) || 'einde' AS body, CASE WHEN o_orderkey % 10 = 0 THEN 'presentatie' ELSE '' END AS extra FROM o WHERE nth = 1)
SELECT o_custkey::VARCHAR AS id, 'den_haag' AS gemeente, name || ' ' || extra AS name, length(body || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'slot' ELSE '' END)::INT AS text_length,
  CASE WHEN length(body || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'slot' ELSE '' END) < 200 THEN 'too_short' ELSE 'kept' END AS length_verdict,
  ((o_orderkey % 3 = 0)::INT + (o_orderkey % 4 = 0)::INT)::INT AS match_count
FROM d WHERE (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0) AND o_orderkey % 10 <> 0
"""
)
def council_letters(spark, sf_dir):
    o = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "Ingekomen brief over ").otherwise("Agenda "), "o_orderpriority", F.lit(" "), F.when(k % 10 == 0, "presentatie").otherwise(""))
    words = F.concat(F.repeat(F.lit("tekst "), (k % 50).cast("int")), F.lit("einde"))
    text = F.when(k % 2 == 0, F.to_json(F.array(words, F.lit(" slot ")))).otherwise(words)
    source = F.struct(name.alias("name"), F.lit("u").alias("url"), F.concat(F.when(k % 4 == 0, "Brief_").otherwise("stuk_"), k.cast("string"), F.lit(".pdf")).alias("file_name"), text.alias("text"))
    hit = F.struct(F.col("o_custkey").cast("string").alias("_id"), F.lit("ori_den_haag_20250410").alias("_index"), F.lit(1.0).alias("_score"), source.alias("_source"))
    pages = o.select(k.alias("page_no"), F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits"))).alias("page"))
    found = council.citizen_letters(council.hits(pages))
    return council.documents(found).select("id", "gemeente", "name", "text_length", "length_verdict", "match_count")


@query(
    """
SELECT source, count(*) AS total, count(*) FILTER (WHERE length(text) BETWEEN 200 AND 20000) AS kept, count(*) FILTER (WHERE length(text) < 200) AS too_short, count(*) FILTER (WHERE length(text) > 20000) AS too_long
FROM documents GROUP BY source
"""
)
def length_funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", council.length_reason(F.col("text")).alias("v"))
    return datasets.funnel(docs, ("source",), **{v: F.col("v") == v for v in ("kept", "too_short", "too_long")})


# ---------------------------------------------------------------- generated letters and prompts

_WRAPPED = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('```text', chr(10), 'Brief: ', text, chr(10), '```') WHEN turn % 3 = 1 THEN concat('"', text, '"') ELSE concat('Natuurlijk, ', text) END AS raw, text
FROM conversations
"""


@query(
    r"""
WITH w AS (SELECT *, CASE WHEN turn % 3 = 2 THEN 'Natuurlijk, ' || trim(text, E' \t\n\r') ELSE trim(trim(text, E' \t\n\r'), '"''') END AS t FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') AS cleaned FROM w)
SELECT conv_id, turn, md5(cleaned) AS text_md5, length(cleaned) BETWEEN 30 AND 4000 AND NOT regexp_matches(lower(cleaned), '^(ik kan|als ai|natuurlijk|zeker,)') AS valid FROM c
"""
)
def generation_cleanup(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    cleaned = spark.sql(_WRAPPED).withColumn("cleaned", T.clean_generated(F.col("raw")))
    return cleaned.select("conv_id", "turn", F.md5(F.col("cleaned").cast("binary")).alias("text_md5"), T.is_valid_generation(F.col("cleaned")).alias("valid"))


_STYLE_ROWS = ", ".join(f"('{s}', '{t}')" for s, t in prompts.STYLES.items())
_LABEL_ROWS = ", ".join("('{}', '{}', '{}')".format(k, d, "\n- ".join(c)) for k, (d, _, c) in prompts.LABEL_PROMPTS.items())
_LABEL_NAMES = ", ".join(f"'{x}'" for x in L.LABELS)


@query(
    f"""
WITH st(style, style_text) AS (VALUES {_STYLE_ROWS}), lb(label, definition, rules) AS (VALUES {_LABEL_ROWS}),
seeds AS (SELECT conv_id, text AS seed, ([{_LABEL_NAMES}])[(conv_id % 9 + 1)::INT] AS label FROM conversations WHERE turn = 0)
SELECT conv_id, label, style, md5('Je schrijft als inwoner aan de gemeente. Stijl: ' || style_text || '. Geef alleen de brief.') AS system_md5,
  md5('Soort brief: ' || label || chr(10) || 'Betekenis: ' || definition || chr(10) || 'Voorbeeld:' || chr(10) || seed || chr(10) || 'Eisen:' || chr(10) || '- ' || rules || chr(10) || '- Kies een ander onderwerp dan het voorbeeld') AS user_md5
FROM seeds JOIN lb USING (label) CROSS JOIN st
"""
)
def prompt_grid(spark, sf_dir):
    """Each first turn is the seed letter of a label; every style asks for a variation of it."""
    first = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", L.label_of((F.col("conv_id") % 9).cast("int")).alias("label"), F.array("text").alias("seeds"))
    seeded = first.join(F.broadcast(prompts.label_table(spark)), "label").drop("examples").withColumnRenamed("seeds", "examples")
    cells = prompts.messages(prompts.grid(seeded, prompts.style_table(spark), 1))
    md5 = lambda i: F.md5(F.col("messages")[i]["content"].cast("binary"))
    return cells.select("conv_id", "label", "style", md5(0).alias("system_md5"), md5(1).alias("user_md5"))


@query(
    f"""
SELECT md5(text || '|formal_long|' || label) AS id, 'synthetic' AS source, label AS labels, 'style=formal_long; model=m' AS notes, 'nl' AS language, false AS pseudonymized
FROM (SELECT text, ([{_LABEL_NAMES}])[(doc_id % 9 + 1)::INT] AS label FROM documents WHERE length(text) BETWEEN 30 AND 4000)
"""
)
def generations_to_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text").between(30, 4000))
    rows = docs.select("text", F.array(L.label_of((F.col("doc_id") % 9).cast("int"))).alias("labels"), F.lit("formal_long").alias("style"))
    return examples.from_generation(rows, "m").select("id", "source", F.array_join("labels", ",").alias("labels"), "notes", "language", "pseudonymized")


_LINES = """
SELECT doc_id, concat('{"id": ', CASE WHEN doc_id % 7 = 0 THEN '5' ELSE concat('"d', cast(doc_id AS string), '"') END, ', "text": "brief", "source": "', CASE WHEN doc_id % 5 = 0 THEN 'krant' ELSE 'gold' END,
  '", "labels": [', CASE doc_id % 4 WHEN 0 THEN '"klacht", "melding"' WHEN 1 THEN '"onbekend"' WHEN 2 THEN '' ELSE '"beroep"' END, ']', CASE WHEN doc_id % 11 = 0 THEN '' ELSE '}' END) AS value
FROM documents
"""


@query(
    """
SELECT 'd' || doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'klacht,melding' WHEN 2 THEN '' ELSE 'beroep' END AS labels, 'gold' AS source FROM documents
WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 1 AND doc_id % 11 <> 0
"""
)
def labelled_lines(spark, sf_dir):
    """Strict scan of JSON lines: records with a wrong type, source or label, and broken ones, are rejected whole."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    kept, _ = examples.split_lines(spark.sql(_LINES).select("value"))
    return kept.select("id", F.array_join("labels", ",").alias("labels"), "source")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 4 = 1 OR doc_id % 11 = 0")
def labelled_line_rejects(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return examples.split_lines(spark.sql(_LINES))[1].select("doc_id")


# ---------------------------------------------------------------- labels, datasets, splits

_EXAMPLES_SQL = f"""
ex AS (
  SELECT vec_id AS id, (vec_id % 3)::VARCHAR AS eval_set, [(x * 10.0)::DOUBLE FOR x IN list_transform(embedding[1:9], lambda v: v::DOUBLE)] AS logits,
    list_filter([{_LABEL_NAMES}], lambda n, i: i = label + 1 OR (vec_id % 10 = 0 AND i = vec_id % 9 + 1)) AS labels FROM embeddings
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored examples from embeddings: logits are ten times the first nine values."""
    e = table(spark, sf_dir, "embeddings")
    names = F.filter(L.names(), lambda n, i: (i == F.col("label")) | ((F.col("vec_id") % 10 == 0) & (i == F.col("vec_id") % 9)))
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("string").alias("eval_set"), F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 10.0).alias("logits"), names.alias("labels"))


@query(f"WITH {_EXAMPLES_SQL} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM ex) GROUP BY label")
def label_distribution(spark, sf_dir):
    return datasets.label_distribution(scored(spark, sf_dir))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_distribution(spark, sf_dir):
    return datasets.source_distribution(table(spark, sf_dir, "documents"))


def _split_sql(bucket: str, train: str, val: str, rest: str = "test") -> str:
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(id::VARCHAR || '|42'), id) - 1 AS rk, count(*) OVER (PARTITION BY bucket) AS n FROM ({bucket})),
split AS (SELECT id, bucket, CASE WHEN rk < floor(n * {train}) THEN 'train' WHEN rk < floor(n * {train}) + floor(n * {val}) THEN 'val' ELSE '{rest}' END AS split FROM r)"""


_RAREST = "SELECT ex.*, coalesce((SELECT label FROM (SELECT unnest(labels) AS label, generate_subscripts(labels, 1) AS i) JOIN c USING (label) ORDER BY n, i LIMIT 1), '__none__') AS bucket FROM ex"
_COUNTS = "c AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM ex) GROUP BY label)"


@query(f"WITH {_EXAMPLES_SQL}, {_COUNTS}, {_split_sql(_RAREST, '0.7::DOUBLE', '0.15::DOUBLE')} SELECT id, bucket, split FROM split")
def stratified_split(spark, sf_dir):
    return datasets.stratified_split(scored(spark, sf_dir).select("id", "labels")).select("id", "bucket", "split")


@query(f"WITH {_split_sql('SELECT doc_id AS id, 1 AS bucket FROM documents', '0.7::DOUBLE', '0.15::DOUBLE')} SELECT id, split FROM split")
def random_split(spark, sf_dir):
    return datasets.random_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))).select("id", "split")


_TR, _VA = 0.7 / (0.7 + 0.15), 1 - 0.7 / (0.7 + 0.15) - 1e-6


@query(
    f"""
WITH {_EXAMPLES_SQL.replace('FROM embeddings', 'FROM embeddings WHERE vec_id % 5 <> 0')}, {_COUNTS}, {_split_sql(_RAREST, f'{_TR!r}::DOUBLE', f'{_VA!r}::DOUBLE', 'val')}
SELECT id, split FROM split UNION ALL SELECT vec_id, 'test' FROM embeddings WHERE vec_id % 5 = 0
"""
)
def external_split(spark, sf_dir):
    rows = scored(spark, sf_dir).select("id", "labels")
    return datasets.external_split(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")).select("id", "split")


@query(
    f"""
WITH {_EXAMPLES_SQL}, {_COUNTS}, {_split_sql(_RAREST, '0.7::DOUBLE', '0.15::DOUBLE')}
SELECT count(*) AS n_total, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
  (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM c) AS labels FROM split
"""
)
def metadata_report(spark, sf_dir):
    split = datasets.stratified_split(scored(spark, sf_dir).select("id", "labels")).withColumn("source", F.lit("gold"))
    report = datasets.metadata_report(split)
    pairs = F.transform(F.map_entries("label_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.select("n_total", "n_train", "n_val", "n_test", F.array_join(pairs, ",").alias("labels"))


@query(f"WITH {_EXAMPLES_SQL} SELECT id, list_transform([{_LABEL_NAMES}], lambda n: CASE WHEN list_contains(labels, n) THEN '1' ELSE '0' END).array_to_string('') AS hot FROM ex")
def encode_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.array_join(F.transform(L.encode(F.col("labels")), lambda x: x.cast("int").cast("string")), "").alias("hot"))


_PROBS = f"{_EXAMPLES_SQL}, pr AS (SELECT *, list_transform(logits, lambda x: 1.0::DOUBLE / (1.0::DOUBLE + exp(-x))) AS p FROM ex)"


@query(
    f"""
WITH {_PROBS}
SELECT id, array_to_string(list_filter([{_LABEL_NAMES}], lambda n, i: p[i] >= 0.5), ',') AS decoded, ([{_LABEL_NAMES}])[list_position(p, list_max(p))::INT] AS top_label, round(list_max(p), 6) AS top_score,
  len(list_filter(p, lambda x: x >= 0.5)) = 0 AS abstains, list_position(p, list_max(p))::INT - 1 AS top_id FROM pr
"""
)
def classify_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).select("id", F.lit("x").alias("text"), L.sigmoid(F.col("logits")).alias("p"))
    done = L.classify(rows, "text", "p")
    return done.select("id", F.array_join(L.decode(F.col("p")), ",").alias("decoded"), "top_label", F.round("top_score", 6).alias("top_score"), "abstains", L.id_of(F.col("top_label")).alias("top_id"))


# ---------------------------------------------------------------- evaluation

_CELLS = f"""
{_PROBS}, cells AS (
  SELECT id, eval_set, i - 1 AS label_id, ([{_LABEL_NAMES}])[i::INT] AS label, p[i] AS p, list_contains(labels, ([{_LABEL_NAMES}])[i::INT])::INT AS y, (i = list_position(p, list_max(p)))::INT AS top
  FROM pr CROSS JOIN range(1, 10) t(i)
)"""
_FAMILIES = """
fam AS (
  SELECT eval_set, 'threshold' AS family, label_id, label, sum(y)::BIGINT AS n_true, sum((p >= 0.5)::INT)::BIGINT AS n_pred, sum((p >= 0.5)::INT * y)::BIGINT AS tp FROM cells GROUP BY ALL
  UNION ALL SELECT eval_set, 'argmax', label_id, label, sum(y)::BIGINT, sum(top)::BIGINT, sum(top * y)::BIGINT FROM cells GROUP BY ALL
), sc AS (
  SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END AS precision, CASE WHEN n_true = 0 THEN 0 ELSE tp / n_true END AS recall, CASE WHEN n_pred + n_true = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_true) END AS f1 FROM fam
)"""
_THRESHOLDS = """
g AS (SELECT i, 0.05::DOUBLE + i * 0.02::DOUBLE AS t FROM range(45) r(i)),
tf AS (SELECT eval_set, label_id, label, i, t, sum(y) AS n_true, 2.0::DOUBLE * sum((p >= t)::INT * y) / (sum((p >= t)::INT) + sum(y)) AS f1 FROM cells CROSS JOIN g GROUP BY ALL),
best AS (SELECT eval_set, label_id, label, CASE WHEN n_true > 0 THEN t ELSE 0.5::DOUBLE END AS threshold, CASE WHEN n_true > 0 THEN f1 END AS f1 FROM tf QUALIFY row_number() OVER (PARTITION BY eval_set, label_id ORDER BY CASE WHEN n_true > 0 THEN f1 ELSE 0 END DESC, i) = 1)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query(f"WITH {_CELLS}, {_FAMILIES} SELECT eval_set, family, label_id::INT AS label_id, label, tp, n_pred, n_true, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sc")
def label_scores(spark, sf_dir):
    return _rounded(evaluation.label_scores(scored(spark, sf_dir)))


@query(f"WITH {_CELLS}, {_FAMILIES} SELECT eval_set, family, round(avg(f1), 6) AS macro_f1, round(CASE WHEN sum(n_pred + n_true) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(tp) / sum(n_pred + n_true) END, 6) AS micro_f1 FROM sc GROUP BY ALL")
def macro_micro_f1(spark, sf_dir):
    return _rounded(evaluation.averages(evaluation.label_scores(scored(spark, sf_dir))))


@query(f"WITH {_CELLS} SELECT eval_set, round(avg(p) FILTER (WHERE y = 1), 6) AS mean_prob_true_class, round(avg(p) FILTER (WHERE y = 0), 6) AS mean_prob_false_class, round(avg(p) FILTER (WHERE y = 1) - avg(p) FILTER (WHERE y = 0), 6) AS prob_gap FROM cells GROUP BY eval_set")
def probability_gap(spark, sf_dir):
    return _rounded(evaluation.probability_gap(scored(spark, sf_dir)))


@query(f"WITH {_CELLS}, {_THRESHOLDS} SELECT eval_set, label_id::INT AS label_id, label, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best")
def best_thresholds(spark, sf_dir):
    return _rounded(evaluation.best_thresholds(scored(spark, sf_dir)))


@query(f"WITH {_CELLS}, {_THRESHOLDS} SELECT c.id, coalesce(string_agg(c.label, ',' ORDER BY c.label_id) FILTER (WHERE p >= threshold), '') AS decoded FROM cells c JOIN best b ON b.eval_set = c.eval_set AND b.label_id = c.label_id GROUP BY c.id")
def decode_with_best_thresholds(spark, sf_dir):
    rows = scored(spark, sf_dir)
    best = evaluation.best_thresholds(rows).groupBy("eval_set").agg(F.transform(F.array_sort(F.collect_list(F.struct("label_id", "threshold"))), lambda x: x["threshold"]).alias("t"))
    return rows.join(best, "eval_set").select("id", F.array_join(L.decode_per_class(L.sigmoid(F.col("logits")), F.col("t")), ",").alias("decoded"))


@query(
    f"""
WITH {_PROBS}
SELECT id, array_to_string(list_transform(list_reverse_sort(list_filter([{{'s': p[i], 'n': ([{_LABEL_NAMES}])[i]}} FOR i IN range(1, 10)], lambda x: x.s >= 0.5)), lambda x: x.n), ',') AS ranked FROM pr
"""
)
def ranked_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.array_join(F.transform(L.ranked(L.sigmoid(F.col("logits"))), lambda x: x["label"]), ",").alias("ranked"))


@query(
    f"""
WITH {_PROBS}, a AS (
  SELECT eval_set, coalesce(list_position(list_transform([{_LABEL_NAMES}], lambda n: list_contains(labels, n)), true), 1)::INT AS t, list_position(p, list_max(p))::INT AS q FROM pr
), every AS (SELECT DISTINCT eval_set, i AS t, j AS q FROM a CROSS JOIN range(1, 10) x(i) CROSS JOIN range(1, 10) y(j))
SELECT eval_set, ([{_LABEL_NAMES}])[t::INT] AS true_label, ([{_LABEL_NAMES}])[q::INT] AS pred_label, count(a.t) AS n FROM every LEFT JOIN a USING (eval_set, t, q) GROUP BY ALL
"""
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(scored(spark, sf_dir))


_TUNED = """
tc AS (SELECT c.eval_set, c.label_id, c.label, sum(y)::BIGINT AS n_true, sum((p >= threshold)::INT)::BIGINT AS n_pred, sum((p >= threshold)::INT * y)::BIGINT AS tp FROM cells c JOIN best b ON b.eval_set = c.eval_set AND b.label_id = c.label_id GROUP BY ALL),
every AS (SELECT eval_set, family, label, label_id, precision, recall, f1, tp, n_pred, n_true FROM sc UNION ALL
  SELECT eval_set, 'self_tuned', label, label_id, CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END, CASE WHEN n_true = 0 THEN 0 ELSE tp / n_true END, CASE WHEN n_pred + n_true = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_true) END, tp, n_pred, n_true FROM tc),
long AS (
  SELECT eval_set, family, label, 'precision' AS metric, precision AS value FROM every UNION ALL SELECT eval_set, family, label, 'recall', recall FROM every UNION ALL SELECT eval_set, family, label, 'f1', f1 FROM every
  UNION ALL SELECT eval_set, family, NULL, 'macro_f1', avg(f1) FROM every GROUP BY ALL
  UNION ALL SELECT eval_set, family, NULL, 'micro_f1', CASE WHEN sum(n_pred + n_true) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(tp) / sum(n_pred + n_true) END FROM every GROUP BY ALL
  UNION ALL SELECT eval_set, 'probability', NULL, 'mean_prob_true_class', avg(p) FILTER (WHERE y = 1) FROM cells GROUP BY ALL
  UNION ALL SELECT eval_set, 'probability', NULL, 'mean_prob_false_class', avg(p) FILTER (WHERE y = 0) FROM cells GROUP BY ALL
  UNION ALL SELECT eval_set, 'probability', NULL, 'prob_gap', avg(p) FILTER (WHERE y = 1) - avg(p) FILTER (WHERE y = 0) FROM cells GROUP BY ALL
)"""


@query(f"WITH {_CELLS}, {_FAMILIES}, {_THRESHOLDS}, {_TUNED} SELECT eval_set, family, label, metric, round(value, 6) AS value FROM long")
def benchmark(spark, sf_dir):
    return _rounded(evaluation.benchmark(scored(spark, sf_dir)))


#: Two models: the logits as they are, and their negation on two of the three sets.
def _two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    other = rows.where("eval_set <> '2'").withColumn("logits", F.transform("logits", lambda x: -x))
    both = rows.withColumns({"model": F.lit("a"), "pos": F.lit(1)}).union(other.withColumns({"model": F.lit("b"), "pos": F.lit(2)}))
    keys = ("model", "pos", "eval_set")
    means = evaluation.averages(evaluation.label_scores(both, keys=keys), keys)
    return means.where("family = 'argmax'").select("model", "pos", "eval_set", F.round("macro_f1", 6).alias("value"))


_MODELS = f"""
{_EXAMPLES_SQL}, m AS (SELECT 'a' AS model, 1 AS pos, * FROM ex UNION ALL SELECT 'b', 2, id, eval_set, list_transform(logits, lambda x: -x), labels FROM ex WHERE eval_set <> '2'),
mc AS (
  SELECT model, pos, eval_set, i, (i = list_position(p, list_max(p)))::INT AS top, list_contains(labels, ([{_LABEL_NAMES}])[i::INT])::INT AS y
  FROM (SELECT *, list_transform(logits, lambda x: 1.0::DOUBLE / (1.0::DOUBLE + exp(-x))) AS p FROM m) CROSS JOIN range(1, 10) t(i)
), mf AS (SELECT model, pos, eval_set, i, CASE WHEN sum(top) + sum(y) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(top * y) / (sum(top) + sum(y)) END AS f1 FROM mc GROUP BY ALL),
mm AS (SELECT model, pos, eval_set, round(avg(f1), 6) AS value FROM mf GROUP BY ALL)"""


@query(
    f"""
WITH {_MODELS}, e AS (
  SELECT DISTINCT eval_set, first_value(model) OVER w AS first_model, last_value(model) OVER w AS last_model, round(first_value(value) OVER w, 6) AS first, round(last_value(value) OVER w, 6) AS last, count(*) OVER (PARTITION BY eval_set) AS n_models
  FROM mm WINDOW w AS (PARTITION BY eval_set ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), d AS (SELECT *, CASE WHEN n_models >= 2 THEN last - first END AS delta FROM e)
SELECT eval_set, first_model, last_model, first, last, n_models, round(delta, 6) AS delta, CASE WHEN delta > 0.001 THEN '↑' WHEN delta < -0.001 THEN '↓' WHEN delta IS NOT NULL THEN '·' END AS arrow FROM d
"""
)
def compare_models(spark, sf_dir):
    return _rounded(evaluation.compare(_two_models(spark, sf_dir)))


@query(f"WITH {_MODELS} SELECT model, pos, round(avg(value), 6) AS value FROM mm GROUP BY ALL")
def compare_means(spark, sf_dir):
    return _rounded(evaluation.mean_over_sets(_two_models(spark, sf_dir)))


@query(f"WITH {_MODELS} SELECT eval_set, max(value) FILTER (WHERE model = 'a') AS a, max(value) FILTER (WHERE model = 'b') AS b FROM mm GROUP BY eval_set")
def compare_side_by_side(spark, sf_dir):
    return evaluation.side_by_side(_two_models(spark, sf_dir), ["a", "b"])


@query(
    """
SELECT o_custkey AS run, o_orderkey AS best_epoch, v AS best_score FROM (
  SELECT o_custkey, o_orderkey, greatest(o_totalprice, o_totalprice * 0.5 + 100000) AS v FROM orders
) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, o_orderkey) = 1
"""
)
def best_epoch(spark, sf_dir):
    history = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("argmax_macro_f1"), (F.col("o_totalprice") * 0.5 + 100000).alias("macro_f1"))
    return evaluation.best_epoch(history, ("run",))


@query(
    f"""
WITH {_CELLS}, c AS (SELECT eval_set, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS segment, label_id, sum(y) AS n_true, sum((p >= 0.5)::INT) AS n_pred, sum((p >= 0.5)::INT * y) AS tp FROM cells GROUP BY ALL),
s AS (SELECT eval_set, segment, 'threshold' AS family, CASE WHEN n_pred + n_true = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_true) END AS f1 FROM c)
SELECT eval_set, segment, family, round(avg(f1), 6) AS macro_f1 FROM s GROUP BY ALL
"""
)
def segmented_f1(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("segment", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    keys = ("eval_set", "segment")
    means = evaluation.averages(evaluation.label_scores(rows, keys=keys), keys)
    return _rounded(means.where("family = 'threshold'").select(*keys, "family", "macro_f1"))


# ---------------------------------------------------------------- agreement


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeller A gives the true labels, B those with a probability of at least one half."""
    rows = scored(spark, sf_dir)
    return rows.select("id", F.col("labels").alias("labels_a"), L.decode(L.sigmoid(F.col("logits"))).alias("labels_b"), F.when(F.col("id") % 4 == 0, "laag").when(F.col("id") % 9 != 0, "hoog").alias("confidence_a"), F.when(F.col("id") % 8 == 0, "twijfel").alias("notes_a"))


_PAIRS = f"{_CELLS}, ab AS (SELECT label, y AS a, (p >= 0.5)::INT AS b FROM cells)"


@query(
    f"""
WITH {_PAIRS}, n AS (SELECT label, count(*) AS n, sum(a * b)::BIGINT AS "both", sum((a > b)::INT)::BIGINT AS only_a, sum((b > a)::INT)::BIGINT AS only_b FROM ab GROUP BY label),
k AS (SELECT *, (n - only_a - only_b) / n AS seen, ("both" + only_a) / n * (("both" + only_b) / n) + (1 - ("both" + only_a) / n) * (1 - ("both" + only_b) / n) AS chance FROM n),
f AS (SELECT *, CASE WHEN chance = 1 THEN 1 ELSE (seen - chance) / (1 - chance) END AS kappa, CASE WHEN 2 * "both" + only_a + only_b = 0 THEN 0 ELSE 2.0::DOUBLE * "both" / (2 * "both" + only_a + only_b) END AS f1 FROM k)
SELECT label, n, "both", only_a, only_b, round(kappa, 6) AS kappa, round(f1, 6) AS f1, kappa < 0.75 OR f1 < 0.7 AS flagged FROM f
"""
)
def labeller_agreement(spark, sf_dir):
    return _rounded(agreement.by_label(sheet(spark, sf_dir)))


@query(
    f"""
WITH {_PAIRS.replace('SELECT label, y AS a', 'SELECT id, label, y AS a')}, d AS (SELECT id, sum((a <> b)::INT)::INT AS n_differences FROM ab GROUP BY id),
e AS (SELECT id, labels, id % 4 = 0 AS low, id % 4 <> 0 AND id % 9 = 0 AS missing, id % 8 = 0 AS noted FROM ex)
SELECT id, n_differences, CASE n_differences WHEN 0 THEN 'accept' WHEN 1 THEN 'reviewer' ELSE 'discussion' END AS route,
  array_to_string(list_filter([CASE WHEN len(labels) = 0 THEN 'labels_missing' END, CASE WHEN missing THEN 'confidence_missing' END, CASE WHEN low AND NOT noted THEN 'note_missing' END], lambda x: x IS NOT NULL), ',') AS breaks,
  (list_contains(labels, 'bezwaar') AND list_contains(labels, 'zienswijze')) OR (list_contains(labels, 'woo_verzoek') AND list_contains(labels, 'informatieverzoek_3_11')) AS rare_pair
FROM d JOIN e USING (id)
"""
)
def labelling_rules(spark, sf_dir):
    done = agreement.rule_breaks(agreement.route_disagreement(sheet(spark, sf_dir)))
    return done.select("id", "n_differences", "route", F.array_join("breaks", ",").alias("breaks"), agreement.has_rare_pair(F.col("labels_a")).alias("rare_pair"))


@query(
    f"""
WITH {_PROBS} SELECT eval_set, count(*) AS n, count(*) FILTER (WHERE ok) AS n_right, round(count(*) FILTER (WHERE ok) / count(*), 6) AS route_score
FROM (SELECT eval_set, labels[1] = ([{_LABEL_NAMES}])[list_position(p, list_max(p))::INT] AS ok FROM pr) GROUP BY eval_set
"""
)
def route_score(spark, sf_dir):
    rows = scored(spark, sf_dir).select("eval_set", F.get("labels", F.lit(0)).alias("true_label"), L.label_of(L.argmax(L.sigmoid(F.col("logits")))).alias("pred_label"))
    return _rounded(agreement.route_score(rows, by=("eval_set",)))


@query("SELECT doc_id FROM documents WHERE (('0x' || substr(md5(doc_id || '|42'), 1, 8))::BIGINT)::DOUBLE < 0.05::DOUBLE * 4294967296")
def manual_check_sample(spark, sf_dir):
    return datasets.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), 0.05, "doc_id")


# ---------------------------------------------------------------- models and streams


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_first_seen(spark, sf_dir):
    """Users by a resumable stream that asks what it has collected before."""
    from lettermill.streaming import jobs

    out = new_path(spark, "stream")
    # as a pattern, the path may be a file or a folder
    landed = jobs.read_landing(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)
    jobs.collect_unseen(landed, "user_id", f"{out}/rows", f"{out}/state").awaitTermination()
    return jobs.collected(spark, f"{out}/rows", landed.schema).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT record_id, count(*) AS n FROM (SELECT doc_id::VARCHAR AS record_id, unnest(regexp_extract_all(text, '\b{_EMAIL_SQL}')) FROM documents) GROUP BY record_id")
def stream_redaction_audit(spark, sf_dir):
    """The redaction job on a stream of documents: audited replacements by record."""
    from lettermill.streaming import jobs

    out = new_path(spark, "stream")
    landed = jobs.read_landing(spark, f"{sf_dir}/document[s].parquet", table(spark, sf_dir, "documents").schema)
    jobs.redact_stream(landed.select("doc_id", "text"), f"{out}/text", f"{out}/audit", f"{out}/state", id_cols=("doc_id",)).awaitTermination()
    return sinks.read_audit(spark, f"{out}/text", f"{out}/audit", "record_id string").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
