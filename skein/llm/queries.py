"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, lines, nbsvm, ordermin, runindex, simhash, toxicity, warc, wordcount

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark, table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = wordcount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_order_minhash": op2_order_minhash,
        "op3_quality": op3_quality,
        "op4_warc": op4_warc,
        "op5_decontaminate": op5_decontaminate,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_token_counts": op7_token_counts,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op8_suffix_dedup": runindex.ORACLE, "op9_line_dedup": lines.ORACLE}
