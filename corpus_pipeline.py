"""A corpus pipeline: toxic texts, repeated lines, near copies and leaked benchmark items go, then sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, stored
from vitalframe.llm.decontaminate import without_leaks
from vitalframe.llm.linededup import drop_lines
from vitalframe.llm.minhash import keep_one
from vitalframe.llm.mixing import mix_sources
from vitalframe.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches."""
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with size, source_size, target and taken.

    A document is its id, source and text: rows without an id and rows that share one are told apart by their texts. Rows
    equal in all three share what the mix takes from them evenly, rounded up.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "_digest").withColumn("_digest", F.md5(F.coalesce("text", F.lit(""))))
    own = ["doc_id", "source", "_digest"]
    mix = mix_sources(docs, carry=("_digest",)).groupBy(*own).agg(
        F.max("size").alias("size"),
        F.max("source_size").alias("source_size"),
        F.max("target").alias("target"),
        F.ceil(F.avg("taken")).cast("long").alias("taken"),
    )
    mix = stored(mix.filter("taken > 0").withColumnsRenamed({c: f"_{c}" for c in own}), "mixed")
    same = [docs[c].eqNullSafe(mix[f"_{c}"]) for c in own]
    return docs.join(mix, same).drop(*[f"_{c}" for c in own], "_digest")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
]

#: The classifier cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus; every stage is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
