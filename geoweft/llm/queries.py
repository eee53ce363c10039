"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_tree, jaccard, licences, linededup, packing, quality, sharding, sql, suffixes, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; edge cases as in ``sharding``."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=16)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of all documents; edge cases as in ``licences``."""
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are 85 % alike; edge cases as in ``jaccard``."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85).drop("text_hash")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; edge cases as in ``html_tree``."""
    found = html_tree.extract_main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 2048; edge cases as in ``packing``."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; edge cases as in ``quality``."""
    verdict = quality.quality(_table(spark, sf_dir, "documents"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings, and words of repeated 50-word passages, of all documents; edge cases as in ``suffixes``."""
    found = suffixes.dedup_suffixes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents; edge cases as in ``decontaminate``."""
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that equal an earlier one or are one word edit from it; edge cases as in ``linededup``."""
    return linededup.duplicate_lines(_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture log of all pages with its revisits resolved; edge cases as in ``warc``."""
    found = warc.resolve_revisits(warc.captures_of_pages(_table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_lines(F.col("headers")))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_licences": op2_licences,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_html_extraction": op4_html_extraction,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc_revisits": op10_warc_revisits,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licences": licences.oracle(),
    "op3_ngram_jaccard": sql.NGRAM_JACCARD,
    "op6_quality": sql.QUALITY,
    "op8_decontamination": sql.DECONTAMINATION,
    "op9_line_dedup": sql.LINE_DEDUP,
    "op10_warc_revisits": warc.ORACLE,
}
