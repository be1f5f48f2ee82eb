"""The training-data pipeline over ``documents``: language ID, near duplicates, benchmark decontamination, PII, SentencePiece."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, jaccard_join, language, pieces, pseudonyms
from fleetlens.llm.shared import stored

#: Least language score; four languages that nothing tells apart have 0.25 each.
LEAST_SCORE = 0.35
KEY = "key of the pseudonyms in this pipeline"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no language (null, no letter) or none that stands out."""
    train = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0)
    found = language.predict(docs, language.train(train), keep=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of five-word shingle sets of similarity 0.8 or more."""
    # a missing id counts as the largest one; rows of one id and text are one document
    name = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(2**63 - 1)).alias("_key")
    links = jaccard_join.linked(docs.select("doc_id", "text"), size=5, percent=80)
    first = links.where("doc_id <=> component_id").select(name("doc_id"))
    kept = docs.select(name("doc_id"), F.sha2("text", 256).alias("_twin"), *docs.columns).join(first, "_key", "left_semi")
    return kept.dropDuplicates(["_key", "_twin"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; a text without an id is a document of its own."""
    return decontamination.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_keys=True).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become pseudonyms; n_chars follows the text."""
    out = pseudonyms.replaced(docs, KEY, count=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (comma-joined) and what they decode to."""
    out = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source", "n_chars"])
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None  # language models, Feistel networks and SentencePiece are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written once, so that none is computed again for the next ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
