"""The operators on the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelwise.llm import (
    classifier, decontam, divergence, infill, licenses, lines, minhash, mixing, packing, quality,
    surrogates, tools, urls,
)

Query = Callable[[SparkSession, str], DataFrame]

#: Verdict, host and path.
URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
#: Parameters of the call that a plain turn stands for.
SCHEMAS = {"answer": [("prompt", "string", True)]}
#: In production a secret of its own; it is never in the results.
PII_KEY = "a key of the caller"
#: Scores from here on are predicted as good.
GOOD = 0.7


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, PII_KEY).select(
        "doc_id", F.col("entities").alias("n_entities"),
        (F.col("entities") > 0).alias("changed"), "text")


def op2_minhash_dedup(spark: SparkSession, path: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, path, "documents"), shingle=4)


def op3_url_filter(spark: SparkSession, path: str) -> DataFrame:
    return urls.filter_urls(_table(spark, path, "pages"), URL_RULES)


def op4_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    return quality.quality_rules(_table(spark, path, "documents"))


def op5_license_scan(spark: SparkSession, path: str) -> DataFrame:
    return licenses.license_labels(_table(spark, path, "documents"))


def op6_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    calls, results = tools.conversation_calls(_table(spark, path, "conversations"))
    return tools.link_calls(calls, results, SCHEMAS)


def op7_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Per document: its lines, the numbers of those removed, and the text that is left."""
    docs = _table(spark, path, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", F.col("line_report.n_lines").alias("n_lines"),
        F.size("line_report.removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.col("line_report.removed").cast("array<string>")).alias("removed"),
        "text")


def op8_quality_classifier(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path, "documents").select("doc_id", "text")
    weights = classifier.fit(docs, _table(spark, path, "labels"))
    return classifier.score(docs, weights).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, path: str) -> DataFrame:
    found = decontam.contamination(
        _table(spark, path, "documents").select("doc_id", "text"),
        _table(spark, path, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op10_source_mix(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, path, "documents"))


def op11_fill_in_middle(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path, "documents").select("doc_id", "text")
    return infill.fill_in_middle(docs, keep_text=False).select("doc_id", *(
        f"infill.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256",
                                "restored_sha256")))


def op12_pack_sequences(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(
        _table(spark, path, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op13_source_divergence(spark: SparkSession, path: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, path, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_tool_calls": op6_tool_calls,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_source_mix": op10_source_mix,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_pack_sequences": op12_pack_sequences,
    "op13_source_divergence": op13_source_divergence,
}
