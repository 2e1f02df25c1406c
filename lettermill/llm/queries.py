"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import decontam, fim, htmlmain, langid, licenses, linededup, media, mixing, personal, resample, sharding, simhash, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in urlfilter.BLOCKED_HOSTS])).alias("key"))
    return urlfilter.judge(_table(spark, sf_dir, "pages"), blocked)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


#: Documents have no paths, so every row gets one: source/lang/hundred/file. Every 25th row is a
#: license file, every 50th one level higher.
_PATH = """concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/',
    CASE WHEN doc_id % 50 = 0 THEN 'LICENSE'
         WHEN doc_id % 25 = 0 THEN concat(cast(floor(doc_id / 100) AS bigint), '/LICENSE')
         ELSE concat(cast(floor(doc_id / 100) AS bigint), '/', doc_id, '.txt') END)"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", F.expr(_PATH).alias("path"), "text"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(_table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.plan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1,
    "op2_benchmark_decontamination": op2,
    "op3_line_dedup": op3,
    "op4_source_mixing": op4,
    "op5_url_filter": op5,
    "op6_html_extraction": op6,
    "op7_sharding": op7,
    "op8_media_columns": op8,
    "op9_license_scan": op9,
    "op10_language_id": op10,
    "op11_importance_resampling": op11,
    "op12_fill_in_middle": op12,
    "op13_personal_data": op13,
}

# Of 13 words with at most 2 substitutions, 4 in a row agree; alignments with 4 equal words, and of shorter items with one, are compared word by word.
_UNSPACED = "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in decontam.UNSPACED)
_WORDS = rf"regexp_extract_all(regexp_replace(lower(text), '([{_UNSPACED}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"
_OP2 = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents)
), dt AS (
  SELECT n AS doc, len(ws) AS n_words, unnest(ws) AS t, generate_subscripts(ws, 1) - 1 AS i FROM docs
), it AS (
  SELECT item_id, len(ws) AS n, unnest(ws) AS t, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark)
), dg AS (
  SELECT doc, i, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w AS g FROM dt WINDOW w AS (PARTITION BY doc ORDER BY i)
), ig AS (
  SELECT item_id, i, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w AS g FROM it WHERE n >= {decontam.WINDOW} WINDOW w AS (PARTITION BY item_id ORDER BY i)
), aligned AS (
  SELECT doc, item_id, dg.i - ig.i AS d FROM dg JOIN ig USING (g)
  UNION SELECT doc, item_id, dt.i - it.i FROM dt JOIN it USING (t) WHERE n < {decontam.WINDOW} AND (n >= {decontam.MIN_WORDS} OR n = n_words)
), eq AS (
  SELECT a.doc, a.item_id, d, n, it.i AS j, (dt.t = it.t)::INT AS e FROM aligned a JOIN it USING (item_id) JOIN dt ON dt.doc = a.doc AND dt.i = it.i + d
), win AS (
  SELECT *, sum(e) OVER w AS s, count(*) OVER w AS c, least(n, {decontam.WINDOW}) AS span FROM eq WINDOW w AS (PARTITION BY doc, item_id, d ORDER BY j ROWS BETWEEN CURRENT ROW AND {decontam.WINDOW - 1} FOLLOWING)
), found AS (
  SELECT doc, item_id, count(*) AS n_windows, min(j + d) AS first_word, max(j + d + span - 1) AS last_word, max(s)::BIGINT AS most_equal
  FROM win WHERE c = span AND s >= span - span * {decontam.MAX_SUBSTITUTIONS} // {decontam.WINDOW} GROUP BY doc, item_id
)
SELECT doc_id, item_id, n_windows, first_word, last_word, most_equal FROM found JOIN docs ON docs.n = found.doc
"""

# The shortest runs with MIN_WORDS words from each line and up to each line; all but a run's first place go.
_OP3 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), c AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM l
), runs AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= {linededup.MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.cum - a.cum + a.w >= {linededup.MIN_WORDS} GROUP BY ALL
), texts AS (
  SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS body FROM runs r JOIN l ON l.doc_id = r.doc_id AND i BETWEEN s AND e GROUP BY ALL
), later AS (
  SELECT doc_id, s, e FROM texts QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT l.doc_id, i FROM later JOIN l ON l.doc_id = later.doc_id AND i BETWEEN s AND e
)
SELECT d.doc_id, count(l.i) AS n_lines, count(gone.i) AS n_removed,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i
GROUP BY d.doc_id
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src
), w AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS weight FROM s
), f AS (
  SELECT *, (source_size * 3)::DOUBLE AS cap, (source_size * 3)::DOUBLE / weight AS fills_at FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY fills_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY fills_at, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), t AS (
  SELECT src, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= fills_at ORDER BY fills_at, src LIMIT 1)) AS target FROM l
), b AS (
  SELECT src, source_size, coalesce(target, 0.0::DOUBLE) AS target, round(coalesce(target, 0.0::DOUBLE))::BIGINT AS budget FROM t
), p AS (
  SELECT doc_id, size, source_size, target, budget,
         coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b USING (src)
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""

_BLOCKED = ", ".join(f"'{h}'" for h in urlfilter.BLOCKED_HOSTS)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
_OP5 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}
), fit AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS nth
  FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), b AS (SELECT unnest([{_BLOCKED}]) AS blocked
), listed AS (
  SELECT DISTINCT n FROM h JOIN b ON host = blocked OR ends_with(host, '.' || blocked)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN listed.n IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN fit ON fit.n = h.n AND nth = 1 LEFT JOIN listed ON listed.n = h.n
"""


def _shard_sql(n: int) -> str:
    one = "-ln(((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{0}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
    scores = ", ".join(f"{{'s': {one.format(i)}, 'i': {i}}}" for i in range(n))
    return f"(list_sort([{scores}])[1]).i"


# The checksum is the table-driven form of CRC-32: a table of 256 entries from its rule, then one step a byte.
_OP7 = f"""
WITH bits(b, c, k) AS MATERIALIZED (
  SELECT range, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 0 FROM range(256)
), t AS MATERIALIZED (SELECT list(c ORDER BY b) AS crc FROM bits
), d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                         lambda c, x: xor(c // 256, crc[(xor(c, x) % 256 + 1)::INT])), 4294967295::BIGINT) AS text_crc32,
         {_shard_sql(8)}::INT AS shard, {_shard_sql(9)}::INT AS grown_shard, md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents, t
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM d
"""

_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}', {}, '{}')".format(i, name, kind, 0 if kind == "whole" else 2 if name in licenses.LAST else 1, text.replace("'", "''")) for i, (name, kind, text) in enumerate(licenses.TEMPLATES))
_MARK_ROWS = ", ".join("('{}', {}::VARCHAR[][], {}::VARCHAR[])".format(name, [list(g) for g in groups], list(others)) for name, (groups, others) in licenses.MARKS.items())
_COMMENT_LINE, _PARAGRAPHS, _SENTENCES = (x.replace("'", "''") for x in (licenses.COMMENT_LINE, licenses.PARAGRAPHS, licenses.SENTENCES))
_OP9 = rf"""
WITH f AS (
  SELECT row_number() OVER () AS n, doc_id, {_PATH} AS path, text FROM documents
), g AS (
  SELECT *, CASE WHEN path IS NULL THEN NULL ELSE regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1) END AS dir,
         regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[sc]e|copying|notice)(\..*)?$') AS hands_on FROM f
), tpl(tid, license, kind, rank, body) AS (VALUES {_TEMPLATE_ROWS}
), tt AS (
  SELECT tid, license, kind, rank, t, count(*) AS c FROM (SELECT tid, license, kind, rank, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS t FROM tpl) WHERE t <> '' GROUP BY ALL
), total AS (SELECT count(text) AS nd FROM f
), dfs AS (
  SELECT t, count(DISTINCT n) AS df FROM (SELECT n, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM f) WHERE t IN (SELECT t FROM tt) GROUP BY t
), idf AS (
  SELECT v.t, ln((1 + nd)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT t FROM tt) v CROSS JOIN total LEFT JOIN dfs ON dfs.t = v.t
), tw AS (
  SELECT tid, license, kind, rank, t, idf, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY tid)) AS w FROM tt JOIN idf USING (t)
), ls AS (SELECT n, hands_on, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '{_PARAGRAPHS}') AS ps FROM g
), units AS (
  SELECT n, 'part' AS kind, unnest(list_concat(ls, ps, flatten(list_transform(ps, lambda p: regexp_split_to_array(p, '{_SENTENCES}'))))) AS body FROM ls
  UNION ALL SELECT n, 'whole', text FROM ls WHERE hands_on
  UNION ALL SELECT n, 'whole', array_to_string(ls[1:coalesce(nullif(coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '{_COMMENT_LINE}')), false), 0), 0) - 1, len(ls))], chr(10)) FROM ls
), lines AS (SELECT n, kind, body, row_number() OVER () AS i FROM units WHERE body IS NOT NULL
), lt AS (
  SELECT n, i, kind, t, count(*) AS c FROM (SELECT n, i, kind, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS t FROM lines) WHERE t <> '' GROUP BY ALL
), norms AS (
  SELECT n, i, sqrt(sum((c * coalesce(idf, ln(1 + nd) + 1)) ** 2)) AS norm FROM lt CROSS JOIN total LEFT JOIN idf USING (t) GROUP BY n, i
), scores AS (
  SELECT n, i, license, rank, sum(lt.c * idf * w) AS dot FROM lt JOIN tw USING (t, kind) GROUP BY n, i, tid, license, rank
), marks(license, groups, others) AS (VALUES {_MARK_ROWS}
), held AS (SELECT n, i, list(t) AS ts FROM lt GROUP BY n, i
), fitting AS (
  SELECT n, i, rank, license, max(round(dot / norm, 6)) AS score FROM scores JOIN norms USING (n, i) JOIN held USING (n, i) LEFT JOIN marks USING (license)
  WHERE round(dot / norm, 6) >= {licenses.MIN_COSINE} AND (groups IS NULL OR (len(list_filter(groups, lambda g: NOT list_has_any(ts, g))) = 0 AND NOT list_has_any(ts, others))) GROUP BY ALL
), apart AS (
  SELECT *, row_number() OVER (PARTITION BY n, i ORDER BY rank, score DESC, license) AS nth, score - lead(score) OVER (PARTITION BY n, i, rank ORDER BY score DESC, license) AS lead FROM fitting
), own AS (
  SELECT n, license AS own_license, rank, score AS own_score FROM apart WHERE nth = 1 AND (lead IS NULL OR round(lead, 6) >= {licenses.MARGIN})
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY rank, score DESC, license) = 1
), r AS (SELECT * FROM g LEFT JOIN own USING (n)
), givers AS (
  SELECT dir AS from_dir, own_license AS handed FROM r WHERE hands_on AND own_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY rank, own_score DESC, own_license, path) = 1
), near AS (
  SELECT r.n, from_dir, handed FROM r JOIN givers ON r.dir = from_dir OR starts_with(r.dir, from_dir || '/') OR from_dir = ''
  QUALIFY row_number() OVER (PARTITION BY r.n ORDER BY length(from_dir) DESC) = 1
)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, handed) AS license, CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
FROM r LEFT JOIN near USING (n)
"""

# The checksum of each distinct word, by the table-driven form of CRC-32 (see _OP7).
_OP11 = r"""
WITH bits(b, c, k) AS MATERIALIZED (
  SELECT range, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 0 FROM range(256)
), t AS MATERIALIZED (SELECT list(c ORDER BY b) AS crc FROM bits
), d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS (SELECT n, unnest(ws) AS w FROM d
), bw AS (SELECT unnest(ws) AS w FROM b
), v AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT)),
                            lambda c, x: xor(c // 256, crc[(xor(c, x) % 256 + 1)::INT])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), t
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket
), tt AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN tt USING (bucket)
), w AS (SELECT n, sum(gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY n
), x AS (
  SELECT n, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN w USING (n)
), r AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rk, count(*) OVER () AS total FROM x WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rk <= 10 * total // 100 THEN rk END AS rank FROM x LEFT JOIN r USING (n)
"""

_OP12 = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), c AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(d, i, 8))::BIGINT) AS h FROM h
), a AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM a
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2,
    "op3_line_dedup": _OP3,
    "op4_source_mixing": _OP4,
    "op5_url_filter": _OP5,
    "op7_sharding": _OP7,
    "op9_license_scan": _OP9,
    "op11_importance_resampling": _OP11,
    "op12_fill_in_middle": _OP12,
}
