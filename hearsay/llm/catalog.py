"""Query keys of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, decontaminate, hard_negatives, langid, line_dedup, lm_score, multi_index, ngram_join, prefix_trie, quality, secret_scan, shards, suffix_dedup
from .common import documents, read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_byte_bpe": lambda spark, sf_dir: bpe.report(documents(spark, sf_dir)),
        "op2_ngram_join": lambda spark, sf_dir: ngram_join.report(documents(spark, sf_dir)),
        "op3_quality_rules": lambda spark, sf_dir: quality.report(documents(spark, sf_dir)),
        "op4_secret_scan": lambda spark, sf_dir: secret_scan.report(documents(spark, sf_dir)),
        "op5_suffix_dedup": lambda spark, sf_dir: suffix_dedup.report(documents(spark, sf_dir)),
        "op6_language_id": lambda spark, sf_dir: langid.report(documents(spark, sf_dir)),
        "op7_sharding": lambda spark, sf_dir: shards.report(documents(spark, sf_dir)),
        "op8_decontaminate": lambda spark, sf_dir: decontaminate.report(documents(spark, sf_dir), read(spark, sf_dir, "benchmark")),
        "op9_lm_scoring": lambda spark, sf_dir: lm_score.report(documents(spark, sf_dir)),
        "op10_line_dedup": lambda spark, sf_dir: line_dedup.report(documents(spark, sf_dir)),
        "op11_hard_negatives": lambda spark, sf_dir: hard_negatives.report(read(spark, sf_dir, "embeddings")),
        "op12_prefix_trie": lambda spark, sf_dir: prefix_trie.report(read(spark, sf_dir, "conversations")),
        "op13_multi_index": lambda spark, sf_dir: multi_index.report(read(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_line_dedup": line_dedup.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
