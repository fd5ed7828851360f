"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm import bpe, embedding_dedup, exact_dedup, language_id, minhash_dedup, packing, quality, substring_dedup, token_counts, url_filter

from glyphweave.workdir import Work


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, _table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(spark, _table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = substring_dedup.FingerprintIndex(spark, f"{Work(spark, 'prints').path}/index")
    return substring_dedup.substring_dedup(spark, docs, index)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(spark, _table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark, _table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_bpe(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(spark, docs, language_id.train(spark, docs))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over web pages, with the language their markup declares, their hosts and address suffixes."""
    model = language_id.train(spark, _table(spark, sf_dir, "documents"))
    host = url_filter.host_and_path(F.col("url"))[0]
    pages = _table(spark, sf_dir, "pages").select("page_id", language_id.page_text(F.col("html")).alias("text"), language_id.page_language(F.col("html")).alias("declared"), host.alias("host"))
    suffix = F.element_at(F.split("host", r"\."), -1)
    return language_id.identify(spark, pages, model, "page_id", "text", "declared", "host", suffix)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")} | {"pages_language_id": pages_language_id}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op3_embedding_dedup": embedding_dedup.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op5_minhash_dedup": minhash_dedup.ORACLE}
