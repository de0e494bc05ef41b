"""Queries of the operators in this subpackage, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import ann, bpe, langid, media, packing, pii, quality, simhash, toxicity, warc
from saltmarsh.llm.common import table


def op1_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op3_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ann_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark, table(spark, sf_dir, "pages"))


def op6_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_langid_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), pii.session_key(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity_subword, op2_media_sniffing, op3_quality_bradley_terry, op4_ann_nn_descent, op5_warc_transactions, op6_bpe_duckdb, op7_simhash_bktree, op8_best_fit_packing, op9_langid_centroids, op10_pii_surrogates)
}

ORACLE_SQL: dict[str, str] = {"op2_media_sniffing": media.oracle(), "op5_warc_transactions": warc.ORACLE}
