"""The opN_ queries: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_quotes, html_extract, language, quality_rules, secrets
from .decontaminate import leaks
from .near_dedup import near_duplicates
from .substring_dedup import substring_dedup
from .token_files import read_tokens, write_tokens

#: Where the public vocabularies lie; the driver reads them and ships their bytes.
TOKENIZERS = os.environ.get("VEILFRAME_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.reply_order(table(spark, sf_dir, "conversations"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    ranks = bpe.read_ranks(f"{tokenizers}/byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, *quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    with open(f"{tokenizers}/byte_bpe_50k.json", encoding="utf-8") as f:
        model = f.read()
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), model, end_id=0))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_all(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=35)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES = (op1_chat_quotes, op2_byte_bpe, op3_decontaminate, op4_near_dedup, op5_quality_rules, op6_html_extract, op7_token_files, op8_language, op9_substring_dedup, op10_secrets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_quotes": chat_quotes.ORACLE}
