"""Sinks: append and overwrite JSON lines, splits, one-row reports, and the separate audit file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.sources import committed


def append_rows(df: DataFrame, path: str, format: str = "json") -> None:
    df.write.mode("append").format(format).save(path)


def overwrite_rows(df: DataFrame, path: str, format: str = "json") -> None:
    df.write.mode("overwrite").format(format).save(path)


def save_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder a split, so that readers prune."""
    df.write.mode("overwrite").partitionBy(split_col).json(path)


def append_once(df: DataFrame, path: str, batch: str, format: str = "json") -> bool:
    """Append the rows of a batch; a batch that is there already is not appended again. Read with read_appended."""
    return committed.commit({f"{path.rstrip('/')}/rows": df}, f"{path.rstrip('/')}/log", batch, format)


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    return committed.read(spark, f"{path.rstrip('/')}/log", f"{path.rstrip('/')}/rows", schema)


def save_redacted(redacted: DataFrame, audit: DataFrame, path: str, audit_path: str, batch: str = "all", format: str = "json") -> bool:
    """Redacted rows and the original values go to different places, are never joined and become visible together.

    The log of commits lies with the redacted rows; it names folders, no values. False if the batch is there already.
    """
    text, values = path.rstrip("/"), audit_path.rstrip("/")
    if text == values or values.startswith(f"{text}/") or text.startswith(f"{values}/"):
        raise ValueError("the audit file must not share the output's folder")
    return committed.commit({f"{text}/rows": redacted, f"{values}/rows": audit}, f"{text}/log", batch, format)


def read_redacted(spark: SparkSession, path: str, schema) -> DataFrame:
    """Redacted rows of the batches that are complete, their audit included."""
    return read_appended(spark, path, schema)


def read_audit(spark: SparkSession, path: str, audit_path: str, schema) -> DataFrame:
    """Original values of the batches that are complete."""
    return committed.read(spark, f"{path.rstrip('/')}/log", f"{audit_path.rstrip('/')}/rows", schema)


def nest_metrics(long: DataFrame) -> DataFrame:
    """Metrics (eval_set, family, label, metric, value) as the one row of a report; values by label become tables `<metric>_per_label`.

    A report holds a few hundred numbers for each evaluation set, whatever the number of examples.
    """
    keys = ("eval_set", "family")
    plain = long.where("label is null").select(*keys, "metric", F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("json"))
    tables = long.where("label is not null").groupBy(*keys, F.concat("metric", F.lit("_per_label")).alias("metric"))
    tables = tables.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "value")))), {"ignoreNullFields": "false"}).alias("json"))
    families = plain.unionByName(tables).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.parse_json("json")))).alias("m"))
    sets = families.groupBy("eval_set").agg(F.map_from_entries(F.collect_list(F.struct("family", "m"))).alias("f"))
    return sets.agg(F.map_from_entries(F.collect_list(F.struct("eval_set", "f"))).alias("evaluations"))


def save_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON document."""
    report.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _entries(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each entry of an object in a variant column, which goes."""
    each = df.sparkSession.tvf.variant_explode(F.col(column).outer()).select(F.col("key").alias(key), F.col("value").alias(value))
    return df.lateralJoin(each).drop(column).where(F.col(key).isNotNull())


def read_report_values(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, eval_set, family, metric, label, value, text): every value of benchmark reports, numbers also as double.

    A report is {"evaluations": {eval_set: {family: {metric: value}}}}, where a value may be a table by
    label. Documents are parsed once, as variants, so any depth and type of value comes through. A report
    that is no JSON has no rows.
    """
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_variant_get(F.try_parse_json("value"), "$.evaluations", "variant").alias("sets"))
    found = _entries(_entries(_entries(text, "sets", "eval_set", "families"), "families", "family", "metrics"), "metrics", "metric", "v")
    is_table = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    tables = _entries(found.where(is_table), "v", "label", "leaf")
    leaves = tables.unionByName(found.where(~is_table).select("path", "eval_set", "family", "metric", F.lit(None).cast("string").alias("label"), F.col("v").alias("leaf")))
    return leaves.select("path", "eval_set", "family", "metric", "label", F.try_variant_get("leaf", "$", "double").alias("value"), F.try_variant_get("leaf", "$", "string").alias("text"))


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, eval_set, family, metric, value): numeric metrics that are not by label, in long form."""
    return read_report_values(spark, *paths).where("value is not null and label is null").select("path", "eval_set", "family", "metric", "value")
