"""Training-corpus pipeline over ``documents``: each stage takes what the one before kept, as Parquet.

language_id drops documents of no learned language; line_dedup drops repeated lines; near_dedup keeps one document of
each group of near copies, by a Jaccard similarity of five-word shingles of 0.8 or more; decontaminate drops documents that hold a benchmark item; packing cuts what is left into
training sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dnstide.llm import near_dedup as near
from dnstide.llm.decontaminate import decontaminate
from dnstide.llm.langid import keep_known_languages
from dnstide.llm.line_dedup import line_dedup_texts
from dnstide.llm.packing import pack
from dnstide.llm.shared import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.near_dedup(docs, words=5, threshold=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", benchmark_decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: Tokens and language models are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
