"""The corpus pipeline: stages that each use one operator of findinglake.llm.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of documents; the last one returns the encoded corpus. `run` writes each
stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.llm import bpe, decontaminate, quality, secrets, simhash
from findinglake.llm.common import read, stored, text_key


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the ordinal model grades harmful or poor."""
    return quality.select_good(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that SimHash links the document with the smallest id stays.

    Rows that repeat its id and text are the same document and stay with it. Documents without id stay only where
    their whole group has none.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_head_id"), F.col("text_key").alias("_head_key")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(heads["_head_id"]) & (text_key(docs["text"]) == heads["_head_key"])
    return docs.join(heads, same, "left_semi")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that share a window of ten words with a benchmark item."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (text_key(docs["text"]) == hit["_hit_key"])
    return docs.join(hit, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark that names its kind; no document goes."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding them gives the text back."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.round_trip(docs, path, pattern)
    return ids.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
