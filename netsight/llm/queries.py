"""The operators as named queries over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.llm import (
    conversations, decontaminate, lattice, line_dedup, mixing, negatives, quality, simhash, style_tree, tokens, toxicity, urls, warc,
)
from netsight.llm.common import table, type_of
from netsight.session import scratch_path

CAPTURED = "2024-01-01T00:00:00Z"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.Unigram.from_ranks())


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_texts(table(spark, sf_dir, "pages"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, tests, near=decontaminate.Near())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near", F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    return urls.url_verdicts(table(spark, sf_dir, "pages"), model)


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines (all), n_removed of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.without_repeats(docs)
    removed = F.aggregate(found.columns[-1], F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "text", F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(warc.marked(pages, "page_id", "url", "html"), scratch_path(spark, "warc"), CAPTURED)
    read = warc.read_archives(spark, archives, type_of(pages, "page_id"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of conversations (null roles and texts as one space) with faults that depend on `conv_id:turn`."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    rows = rows.where("fault != 0").withColumns({"role": role, "text": text}).withColumn("copy", copies)
    return rows.select("conv_id", "turn", "role", "text")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversations.summaries(damaged(turns))
    every = turns.select(F.col("conv_id").alias("c")).distinct()
    rows = every.join(found, every["c"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in conversations.COUNTS]
    nothing = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return rows.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), nothing)


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts,
        "op2_near_duplicates": near_duplicates,
        "op3_main_text": main_text,
        "op4_quality_rules": quality_rules,
        "op5_contamination": contamination,
        "op6_url_filter": url_filter,
        "op7_line_dedup": without_repeats,
        "op8_source_mix": source_mix,
        "op9_web_archives": web_archives,
        "op10_toxicity": toxicity_scores,
        "op11_conversation_repair": conversation_repair,
        "op12_hard_negatives": hard_negatives,
        "op13_near_vectors": near_vectors,
        "pipeline": pipeline,
    }
