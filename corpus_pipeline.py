"""From raw documents to a training mix, in five stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netsight.llm import decontaminate, line_dedup, mixing, quality, simhash
from netsight.llm.common import BLANK_CHARS, fresh, table, with_mark
from netsight.session import cut_lineage

KEY, TEXT = "doc_id", "text"
#: Near-duplicates: words of a shingle, bits in which fingerprints may differ.
SHINGLE, DISTANCE = 3, 2


def _with_size(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars, where there is such a column, brought up to date with the text."""
    size = F.length(TEXT).cast("bigint")
    return docs.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    marked, mark = with_mark(docs, KEY, TEXT)
    kept = quality.judged(marked, mark, TEXT).where("kept").select(mark).distinct()
    return marked.join(kept, mark, "left_semi").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages go; so do documents that lose all their words by that."""
    found = line_dedup.without_repeats(docs, KEY, TEXT)
    spans = F.col(found.columns[-1])
    left = F.btrim(F.coalesce(TEXT, F.lit("")), F.lit(BLANK_CHARS)) != ""
    return _with_size(found.where(spans.isNull() | left), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash (three-word shingles, two bits): the one with the
    smallest doc_id (null last). Texts without words are one group; rows equal in doc_id and text are repeats of one
    document, of which one row stays. An empty table gives an empty one."""
    marked, mark = with_mark(docs, KEY, TEXT)
    groups = cut_lineage(simhash.near_duplicates(marked, mark, TEXT, shingle=SHINGLE, distance=DISTANCE))
    chosen = groups.select(F.col("component_id").alias(mark)).distinct()
    kept = marked.join(chosen, mark, "left_semi")
    # Rows equal in doc_id and text have the same mark: one of them stays.
    (place,) = fresh(kept, "_place")
    first = F.row_number().over(Window.partitionBy(mark).orderBy(mark))
    return kept.withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    marked, mark = with_mark(docs, KEY, TEXT)
    hit = decontaminate.contamination(marked, table(spark, sf_dir, "benchmark"), mark, TEXT).where("n_hit > 0")
    return marked.join(hit.select(mark).distinct(), mark, "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that the mix takes, with `copies`: how often it is to be read."""
    marked, mark = with_mark(docs, KEY, TEXT)
    mixed = mixing.mix(marked, mark, TEXT, "source").where("taken > 0")
    copies = mixed.select(F.col(mark), F.expr("cast(taken div size as bigint)").alias("copies")).distinct()
    return marked.join(copies, mark).select(*docs.columns, "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL cannot express the expectation-maximisation of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
