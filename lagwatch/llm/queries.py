"""The registered queries of the text operators. Each derives the stated columns from the
operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwatch.llm import (alignment, decontamination, infilling, jaccard, language, lattice, lines, packing, quality, repeats,
                          secrets, toxicity)
from lagwatch.llm.common import documents, staged
from lagwatch.llm.token_store import TokenStore


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_output(spark: SparkSession, d: str) -> DataFrame:
    store = TokenStore.write(documents(spark, d), tokenizer(), end_id=2)
    return store.read().select("doc_id", "start", "n_tokens", "ids_crc32")


def best_fit(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(documents(spark, d), tokenizer(), end_id=0, capacity=2048)


def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return lines.drop_common_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return quality.clean_lines(docs, with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"), 5, 0)))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def toxic_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~language.held_out(F.col("doc_id"), 5, 0)))
    return toxicity.score(docs, model).select(
        "doc_id", language.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def lattice_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 7, 2)
    model, words = lattice.fit(docs.where(~held), tokenizer("piece_bpe_32k.model"))
    # the model's score is that of the whole lattice, training words as arcs included
    return lattice.score(docs, model, words).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", F.col("word_score").alias("score"), F.col("score").alias("piece_score"))


def benchmark_leaks(spark: SparkSession, d: str) -> DataFrame:
    """One row per document and item found in it; documents without a match give none."""
    return decontamination.matches(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.with_components(documents(spark, d), jaccard.Rule(n=4, num=85, den=100))


def suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    cut = repeats.remove_repeats(documents(spark, d).select("doc_id", "text"), length=400)
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")), F.lit(0).cast("long"),
                          lambda total, s: total + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def token_alignment(spark: SparkSession, d: str) -> DataFrame:
    groups = F.col("groups")
    rows = alignment.align(documents(spark, d), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    rows = staged(rows.withColumn("groups_sha256", F.when(groups == "", "").otherwise(F.sha2(groups, 256))).drop("groups"), "aligned")
    return alignment.count_links(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    spans = F.col("spans")
    counts = [F.size(secrets.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return secrets.scan(documents(spark, d)).select(
        "doc_id", *counts, F.sha2(secrets.listed(secrets.of_kind(spans, *secrets.BASE_KINDS)), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"))


def fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    output = F.col("output")
    return infilling.fill_in_middle(documents(spark, d)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"),
        F.sha2(infilling.restored(output, F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join,
    "op2_quality_rules": quality_rules,
    "op3_token_output": token_output,
    "op4_best_fit": best_fit,
    "op5_toxicity": toxic_scores,
    "op6_suffix_dedup": suffix_dedup,
    "op7_line_dedup": line_dedup,
    "op8_language_id": language_id,
    "op9_benchmark_leaks": benchmark_leaks,
    "op10_lattice_scores": lattice_scores,
    "op11_token_alignment": token_alignment,
    "op12_secret_scan": secret_scan,
    "op13_fill_in_middle": fill_in_middle,
}
