"""A corpus pipeline: documents to the tokens of a training mix.

Each stage is a function of (spark, docs, sf_dir) that calls one operator on all rows its predecessor kept. Its
result is written as Parquet in the shared folder and read again as the next one's ``docs``.

1. quality: a classifier learned from ``labels`` (without the held-out rows) rejects poor documents.
2. near_dedup: of each group of SimHash near-duplicates the document with the smallest id stays.
3. substring_dedup: passages of 50 words or more that also stand in a document with a smaller id are taken out.
4. mix: sources are mixed to target weights; a document appears as often as the mix takes it.
5. tokens: each text is encoded; ids, their number and a digest of the decoded text are returned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, mixture, phrase_dedup, quality, simhash
from evalspark.llm.common import cut, table


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return df.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", reject_poor),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

#: The classifier, the dedup by passages and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
