"""A training corpus in five stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents. run() writes what a stage returns
as Parquet in the shared checkpoint folder and reads it again as the next one's docs; a
stage's files go once the next one is written, those of the last stage stay.

Nulls, empty and very long texts, ties, repeated rows and empty tables are as each stage's
operator defines them; extra columns of documents pass all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec
from .common import checkpoint_dir, held_out, remove, tokenizer_path

#: No stage of sampled sketches or token ids has a twin in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go."""
    return language_id.keep_identified(docs, language_id.learn(docs, ~held_out()))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    kept = line_dedup.drop_boilerplate(docs, ratio=0.1, min_pages=5)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    return minhash_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the source schedule."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the decoded text."""
    model = sentencepiece_codec.load_model(tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_codec.encode(docs, model, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
