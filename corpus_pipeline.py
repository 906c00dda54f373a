"""Corpus pipeline: quality rules, near duplicates, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fieldspark.llm import decontamination, mixing, ngram_join, quality, tokens
from fieldspark.session import scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, quality.learn_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates; of rows with one id one.

    Rows with a null id have no component and stay.
    """
    groups = ngram_join.ngram_jaccard_join(docs)
    heads = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_head")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_r"))
    named = rows.where("_r.doc_id IS NOT NULL").join(heads, F.expr("_r.doc_id = _head"), "left_semi")
    order = W.partitionBy("_r.doc_id").orderBy(F.xxhash64("_r"))  # rows of one id: all but always one
    first = named.withColumn("_row", F.row_number().over(order)).where("_row = 1").select("_r.*")
    return first.unionByName(docs.where("doc_id IS NULL"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time perhaps cut."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back."""
    found = tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "n_symbols")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_leaks),
    ("source mix", mixed),
    ("token files", token_files),
]

#: the quality chain, the leak search and the tokenizer have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
