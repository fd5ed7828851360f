"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that its predecessor kept. Rows without an id stay in the filtering stages, as no
decision can name them; if one id has several texts, they share the fate of the best of them. Extra columns
are carried along. Texts that lose words get a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm import exact_dedup, language_id, minhash_dedup, packing, substring_dedup
from glyphweave.workdir import Work, scratch

#: Words in a shingle, and percent of the union that two sets of shingles must share.
SHINGLE, PERCENT = 5, 80


def _named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``kept``, and rows without an id."""
    marks = kept.select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(marks, docs["doc_id"] == marks["__keep"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages, or without letters, go."""
    model = language_id.train(spark, docs)
    return _named(docs, language_id.identify(spark, docs, model).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.keep_first(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return _named(docs, minhash_dedup.near_dedup(spark, docs, shingle=SHINGLE, percent=PERCENT).where("kept"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier as well go; every document stays."""
    left = substring_dedup.without_repeats(spark, docs)
    if "n_chars" not in left.columns:
        return left
    kind = dict(left.dtypes)["n_chars"]
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_dedup", near), ("substring_dedup", substring), ("best_fit_packing", pack)]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
