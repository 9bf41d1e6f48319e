"""The training-text pipeline: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the
last one a row for each packed piece. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import crf_language, decontaminate, near_dedup, packing, secrets
from voxmill.llm.shared import aside, written

#: Documents are rejected if the model knows less than this share of their words' byte trigrams, averaged over words: no language of the corpus explains them. Texts that mix languages pass.
LEAST_KNOWN = 0.6
CAPACITY = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those no language explains; fills in a missing ``lang``."""
    held, back = aside(docs, "doc_id", "text", "lang")
    judged = crf_language.identify(held).where((F.col("lang_pred") != crf_language.UNKNOWN) & (F.col("known") >= LEAST_KNOWN))
    return back(judged.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest doc_id, and of repeated rows of it one."""
    held, back = aside(docs, "doc_id", "text")
    numbered = written(near_dedup.numbered(held), "numbered")  # numbered once: a second scan may be split otherwise
    groups = near_dedup.near_duplicates(numbered, n=5, percent=80)
    return back(numbered.join(near_dedup.representatives(groups), "rid", "left_semi"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.drop_contaminated(docs, items, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; ``n_chars`` follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into bins of ``CAPACITY`` words, no two documents of one source in a bin."""
    return packing.pack_documents(docs, CAPACITY)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontaminate", decontamination), ("secret_scan", secret_scan), ("best_fit_packing", best_fit)]

#: Models, signatures and packing are beyond SQL; tests compare the stages, one by one, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
