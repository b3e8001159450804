"""Corpus preparation, stage by stage.

Every stage takes all documents that the one before kept, written as Parquet, and returns
the columns of documents; the last returns the mix. Texts that are null, or without words,
get the classifier's bias as score, so they stay where good labels are common enough; the
other filters keep them. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelwise.llm import classifier, decontam, lines, minhash, mixing
from duelwise.llm.columns import free_name
from duelwise.llm.scratch import settle

#: Least quality score of a document that stays.
GOOD = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on those given."""
    weights = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free_name(docs, "quality_score")
    return classifier.score(docs, weights, out=out).filter(F.col(out) >= GOOD).select(
        *docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines similar to earlier ones. A document goes if it loses all its words;
    n_chars follows the text."""
    out = free_name(docs, "line_report")
    cleaned = lines.dedup_lines(docs, out=out)
    cut = F.size(f"{out}.removed") > 0
    lost = cut & ~F.coalesce(
        F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    cleaned = cleaned.filter(~lost)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(
            cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every group of near duplicates."""
    found = minhash.near_duplicates(docs, shingle=5)
    gone = settle(found.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of the sources takes."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("source mix", mixed),
]

#: SQL can't express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
