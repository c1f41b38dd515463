"""Queries of this subpackage, one per operator with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontam, fim, idfile, langid, license_scan, linededup, minhash, norm_buckets, oracle, resample, secret_scan, toxicity, vptree
from factweave.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return idfile.id_file_report(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end_id=2, added=True)


def op3_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    found = langid.identify(docs, train=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_fenwick_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=42)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_products(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_simple8b_ids, op3_classifier_chain, op4_ftrl_language, op5_line_runs, op6_circulant_minhash, op7_spaced_seeds, op8_vantage_point_trees, op9_rare_token_index, op10_token_efficiency, op11_fenwick_fim, op12_norm_buckets, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_runs": oracle.LINES, "op6_circulant_minhash": oracle.NEAR_DUPLICATES, "op11_fenwick_fim": oracle.FILL_IN_MIDDLE, "op12_norm_buckets": oracle.TOP_PRODUCTS, "op13_importance_resampling": oracle.RESAMPLING}
