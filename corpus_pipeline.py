"""The training-corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last
adds each row's shard and slot. Rows that a mix repeats share a doc_id, hence a shard.

Cases: a null or letterless text has no language and goes in the first stage. Null ids, sources and
languages are values like others: rows are judged by their text, and a null source is a source. A
row of a near-duplicate group stays once, however often it repeats. Texts of any length are read
whole. Further columns pass through all stages, whatever their names; only the last calls those that
have the name of a column of its own `own_<name>`. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import decontam, langid, mixing, sharding, simhash
from lettermill.llm.common import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word Jaccard >= 0.8 stays: that with the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard, its slot there and its shard among one more."""
    return sharding.assign(docs, keep_columns=True).withColumn("law", F.lit("key"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard),
]

#: SQL can express neither the language model nor SimHash components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i + 1 < len(STAGES) else docs
    return docs
