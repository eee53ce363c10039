"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of documents.

In every stage other columns pass through by place, whatever their names; an empty table gives an empty one;
texts are taken whole, however long; equal rows are treated alike but for the near-duplicate stage, which
keeps one of them.  What a stage does with nulls and ties is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import decontaminate, jaccard, linededup, packing, quality
from geoweft.llm.store import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and so do rejected documents: a null or empty text is one; a null source is a host; a line at a limit stays."""
    return _counted(quality.filter_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one word edit of an earlier line go (short ones if equal), and so do documents that have no word left (null texts too); of equal lines that of the least id stays, null ids last."""
    return _counted(linededup.dedup_lines(docs).filter("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word n-grams, similarity 0.8): that of the least id, null ids last; texts without words stay."""
    return jaccard.keep_one(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and so do documents that are little else; null texts and items match nothing; a document hit in exactly half stays."""
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048; a null text is the separator alone; equal lengths are ranked by id, piece and CRC."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Hashing, edit-neighbourhood and packing stages are beyond SQL; a test runs a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
