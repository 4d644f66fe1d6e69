"""The corpus pipeline: language ID, near-dedup, decontamination, secret masking, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet to the shared
folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontaminate, language, near_dedup, secrets
from veilframe.llm.common import written
from veilframe.llm.queries import TOKENIZERS, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are given a language stay; those without a text or a letter go."""
    return language.accepted(docs, language.learn_unheld(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays, the one of the least doc_id."""
    found = near_dedup.near_duplicates(docs, k=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their secrets masked and n_chars counted anew."""
    return secrets.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document; the ids were decoded again for the last digest."""
    return bpe.round_trip(docs, bpe.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("secrets", secrets_stage), ("encode", encode_stage)]

#: SQL can't express learned profiles, similarity joins or the tagger; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
