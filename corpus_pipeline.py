"""A corpus pipeline of the training-data operators: each stage's result is the next one's documents.

language_id   drops texts without a language, or with less than half of their letters in words that a learned script fits
exact_dedup   keeps the first of equal texts
ngram_join    keeps one document of each component of near copies (5-word shingles, similarity 0.8)
mixing        drops and repeats documents so that sources come to their target weights
bpe           encodes to token ids, and decodes again for the round trip's digest
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, exact_dedup, langid, mixing, ngram_join
from dossier.llm.common import small_batches
from dossier.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identified_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("bpe", encode)]

#: The stages learn, link and tokenize; SQL can't say these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
