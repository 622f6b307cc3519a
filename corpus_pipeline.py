"""A corpus pipeline over ``documents``: five stages, each one operator, each written and read again.

Quality rules drop rejected documents; line dedup rewrites texts (and n_chars with them); the n-gram
Jaccard join (five words, 0.8) keeps the document with the smallest id of each group of near copies;
decontamination drops documents that hold a benchmark item; the last stage encodes what is left.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from hearsay.llm.common import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).filter("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return x.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return decontaminate.decontaminate(docs, items).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and the digests of the ids and of the decoded bytes."""
    x = bpe.encode(docs.select("doc_id", "text", "lang", "source"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return x.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: The quality stage learns its references from the table; SQL can't express the later ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
