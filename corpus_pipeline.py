"""Corpus preparation: quality, exact copies, near copies, benchmark passages, tokens.

Every stage takes all that the one before it kept; between stages ``run`` writes
the documents to the folder that driver and executors share and reads them back,
so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, quality
from graphloom.llm.common import materialise, table
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.near_dedup import near_dedup
from graphloom.llm.registry import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to these documents and the trusted positives, does not reject."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.select_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in white space at most."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by 80 % of their five-word shingles."""
    return near_dedup(docs, size=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, its token ids and digests of them and of the text that they decode to; no copies are left to gather."""
    return bpe.round_trip(docs, tokenizer_path(spark), with_ids=True, together=False)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("bpe", to_tokens),
]
#: The classifier, signatures and suffix arrays have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
