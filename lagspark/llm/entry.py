"""Queries of the training-data operators over the tables of a folder, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, clustering, embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, mixing, packing, pipeline, sentencepiece_codec, substring_dedup, toxicity, whitening,
)
from .common import held_out, read, tokenizer_path

def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    model = sentencepiece_codec.load_model(tokenizer_path("piece_bpe_32k.model"))
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"), model, columns=columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot, release, deadline and position of every document under square-root weights."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("doc_id", "source", "block", "slot", "release", "deadline", "position")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, and a digest of what stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = line_dedup.drop_boilerplate(docs, ratio=0.1, min_pages=5, counts=True)
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside repeated windows of 35 words."""
    return substring_dedup.digests(read(spark, sf_dir, "documents"), width=35)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scorer = toxicity.learn(docs, labels, ~held_out())
    found = toxicity.score(docs, scorer, threshold=0.3)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_clauses")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all embeddings at cosine 0.95."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), 0.95)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.learn(docs.select("doc_id", "text", "lang"), ~held_out())
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens by best fit decreasing."""
    tokenizer = packing.load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer, size=2048, end_id=1, with_ids=False)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds of exponion search."""
    points = clustering.whole(read(spark, sf_dir, "embeddings"), dim=64, scale=64)
    start = clustering.first_by_hash(points, 16, seed=1)
    return clustering.cluster(points, start, rounds=3)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components of all, whitened."""
    found = whitening.whiten(read(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100000)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_mixing": op2_mixing,
        "op3_html_extract": op3_html_extract,
        "op4_nearest": op4_nearest,
        "op5_line_dedup": op5_line_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_language_id": op9_language_id,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_packing": op11_packing,
        "op12_clustering": op12_clustering,
        "op13_whitening": op13_whitening,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op2_mixing": mixing.SQL, "op5_line_dedup": line_dedup.SQL}
