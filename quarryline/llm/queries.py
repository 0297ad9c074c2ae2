"""The queries of this subpackage: each applies its operator, with production
parameters, to its whole table. ORACLES has DuckDB SQL for those that SQL can
express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import table as _table
from . import byte_bpe, decontamination, license_scan, quality, secret_scan, simhash, substring_dedup, token_counts, url_filter, warc
from .oracles import ORACLES


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), *token_counts.default_tokenizer())
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), *byte_bpe.default_ranks())
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    page = F.when(F.col("record_id") != "null", F.col("record_id")).cast("long").alias("page_id")
    return records.select(page, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_counts, op3_byte_bpe, op4_substring_dedup, op5_license_scan,
        op6_warc, op7_simhash, op8_secret_scan, op9_url_filter, op10_quality_rules,
    )
}
__all__ = ["ORACLES", "QUERIES"]
