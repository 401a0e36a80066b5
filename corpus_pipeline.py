"""A corpus pipeline of five stages; each works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from spanloom.llm.common import fresh, stash, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go.

    Null or empty text, language, source or length are features like others; without labels of both kinds nothing is
    rejected but where all labels are bad; rows without an id stay; rows that share an id stay if any of them is good;
    other columns pass.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing is left goes with them.

    Null or empty text, and rows without an id, stay as they are; rows that share an id are one document, so none is a
    repeat of the other at the same line; ``n_chars`` follows a text that was cut; other columns pass, whatever
    their names.
    """
    count = fresh("lines_removed", *docs.columns)
    done = line_dedup.drop_lines(docs, least=1).where((F.col(count) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))
    return done.select(docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, by any path, the one with the smallest id stays.

    Texts without words, and rows without an id, link with nothing and stay; rows that share the smallest id all stay;
    other columns pass.
    """
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, with all rows of their id.

    Null or empty texts and items match nothing; rows without an id stay; other columns pass.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; null text is empty, a null id stays, other columns end here."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", cut_lines),
    ("ngram_jaccard_join", keep_one),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: No stage can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
