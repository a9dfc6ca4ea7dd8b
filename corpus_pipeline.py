"""The corpus pipeline: toxicity, near duplicates, secrets, packing. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm import minhash, packing, secrets, toxicity
from facetflow.llm.common import read_table, scratch_path
from facetflow.llm.queries import tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under the threshold stay. Each is judged by its own text, so null and repeated ids don't matter."""
    return toxicity.accepted(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest id, null ids last, then the first row. Rows without words stay."""
    return minhash.distinct_rows(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets other than copied examples are masked in each row's own text, and n_chars follows."""
    masked = secrets.redacted(docs, repository=["source", "lang"], owner=["source"])
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("near duplicates", keep_one_of_each), ("secrets", redact_secrets), ("packing", pack)]

#: SQL expresses neither the string kernel machine nor the packing: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
