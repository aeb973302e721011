"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import chat_format, embedding_dedup, exact_dedup, language_id, license_scan, merkle, minhash_dedup, mixing, packing, quality, sharding, suffix_dedup, vector_codes
from trajlake.llm.common import fold_ascii


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharding.shard_documents(docs, 40).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    training = docs.where(~held_out)
    return language_id.identify_languages(docs.select("doc_id", "text"), training).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, threshold=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return merkle.audited(docs, F.when(tampered, fold_ascii(F.col("text"))).otherwise(F.col("text")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = vector_codes.with_label_errors(coded)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(vector_codes.books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding, op2_mixing_sources, op3_language_id, op4_chat_formatting,
        op5_embedding_near_dedup, op6_minhash_near_dedup, op7_exact_dedup, op8_best_fit_packing, op9_license_scan, op10_quality_classifier,
        op11_merkle_manifest, op12_vector_codes, op13_suffix_array_dedup,
    )
}
