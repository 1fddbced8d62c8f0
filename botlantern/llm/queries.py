"""The thin queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, embeddings, extraction, filter_audit, language, licenses, minhash, packing, secrets, sharding, token_store, whitening
from .common import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_digest(read_table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extraction_digest(read_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(read_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(read_table(spark, sf_dir, "conversations"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_token_store": op3_token_store,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_language_id": op8_language_id,
        "op9_license_scan": op9_license_scan,
        "op10_chat_format": op10_chat_format,
        "op11_filter_audit": op11_filter_audit,
        "op12_secret_scan": op12_secret_scan,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontam.SQL,
        "op2_minhash_dedup": minhash.SQL,
        "op6_embedding_dedup": embeddings.SQL,
        "op10_chat_format": chat.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op12_secret_scan": secrets.SQL,
    }
