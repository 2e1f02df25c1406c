"""Open-data catalog pages (JSON) to dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats that machines read.
MACHINE_READABLE = ("json", "csv", "xml", "jsonl", "ndjson", "tsv", "geojson")
EXCERPT = 300

RESOURCE = "struct<format:string,url:string,name:string>"
DATASET = (
    "id string, name string, title string, organization struct<title:string,name:string>, license_id string, license_title string, "
    f"metadata_modified string, notes string, resources array<{RESOURCE}>"
)
PAGE = "success boolean, result struct<results:array<struct<" + ", ".join(":".join(f.split(" ", 1)) for f in DATASET.split(", ")) + ">>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a landed page file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("page"))


def datasets(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """Datasets of the pages whose success is true; other and malformed pages give none."""
    page = F.from_json(F.col(page_col), PAGE)
    return pages.select(page.alias("p")).where("p.success").select(F.explode("p.result.results").alias("d")).select("d.*")


def machine_readable(resources: Column) -> Column:
    """Resources in a machine-readable format; null gives none."""
    kept = F.filter(resources, lambda r: F.trim(F.lower(r["format"])).isin(*MACHINE_READABLE))
    return F.coalesce(kept, F.array().cast(f"array<{RESOURCE}>"))


def summarize(found: DataFrame) -> DataFrame:
    """Twelve columns a dataset. A missing format counts as '' among all formats."""
    resources = F.coalesce("resources", F.array().cast(f"array<{RESOURCE}>"))
    readable = machine_readable(F.col("resources"))
    lower = lambda r: F.coalesce(F.lower(r["format"]), F.lit(""))
    return found.select(
        "id",
        "name",
        "title",
        F.coalesce(F.nullif("organization.title", F.lit("")), F.col("organization.name")).alias("organization"),
        "license_id",
        "license_title",
        "metadata_modified",
        F.substring(F.coalesce("notes", F.lit("")), 1, EXCERPT).alias("notes_excerpt"),
        F.size(resources).alias("n_resources_total"),
        F.size(readable).alias("n_resources_machine_readable"),
        F.transform(readable, lambda r: F.struct(lower(r).alias("format"), r["url"].alias("url"), r["name"].alias("name"))).alias("machine_readable_urls"),
        F.array_sort(F.array_distinct(F.transform(resources, lower))).alias("all_resource_formats"),
    )
