"""The registered queries of this subpackage: thin, over whole tables, digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import brown_lm, byte_bpe, decontaminate, line_dedup, merkle, ngram_join, pii, quality, repair_ids, toxicity
from spanloom.llm.common import table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.drop_lines(docs, least=1)  # of two columns, so the count has its own name
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.col("lines_removed").cast("bigint").alias("lines_removed"), F.char_length(text).cast("bigint").alias("n_chars_kept"), F.sha2(text, 256).alias("text_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_cotraining, op3_line_dedup, op4_decontaminate, op5_ngram_jaccard, op6_pii, op7_repair_ids, op8_byte_bpe, op9_toxicity, op10_merkle)}
#: None of them can be said in SQL at a bearable cost; tests hold them against brute force.
ORACLE: dict[str, str] = {}
