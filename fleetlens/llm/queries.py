"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    context_tree, decontamination, jaccard_join, language, licences, merkle, neighbours, oracles, pieces, pseudonyms, substring_dedup,
    vector_codes, warc, weighted_sampling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = "key of the pseudonyms in these queries"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(key: str = "doc_id") -> Column:
    """0 to 4 by the CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5


@query
def op3_context_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = context_tree.scored(docs, fold() != 1, keep=["doc_id"])
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


@query
def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pieces.encoded(docs, MODEL, keep=["doc_id"], keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold() != 0))
    return language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf, "documents").select("doc_id", "text"), keep_text=False)


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf, "pages"), keep_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to
FROM q
"""


@query
def op2_weighted_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_sampling.fingerprinted(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op1_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a tree source/thousand/hundred/id, each of which speaks for its directory."""
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100"), F.col("doc_id"))
    found = licences.scanned(docs.select(path.alias("path"), "text"), licence_file=F.lit(True))
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "licence", "score", "origin", "directory")


@query
def op4_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonyms.replaced(table(spark, sf, "documents").select("doc_id", "text"), KEY)


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontamination.marked(docs, table(spark, sf, "benchmark"), null_keys=True).drop("text")


@query
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf, "embeddings"))


ORACLES["op11_vector_codes"] = oracles.VECTOR_CODES


@query
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], altered=merkle.lowered())


ORACLES["op12_merkle_manifest"] = oracles.MERKLE


@query
def op13_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)
