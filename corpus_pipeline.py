"""From raw documents to a training mix: classify, drop repeated lines, near copies and benchmark text, mix sources.

Each stage gets what its predecessor kept and returns the columns of documents; the last one adds those of the mix.

Defined results, in every stage: a document is a row's doc_id and text, null as any other value; repeated rows of a
document share its fate, and rows that have only the doc_id in common don't. Null texts have no words, lines or
shingles: they are scored as empty ones, lose nothing, are near copies of nothing and add nothing to the mix, so the
last stage drops them. Very long texts are read whole. Of near copies the document that comes first stays, a null
doc_id before all others. Empty tables give empty results. Columns beyond those of documents are not read, whatever
they are called; without labels of both kinds the classifier gives all documents the labels' mean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.line_dedup import RUN, dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import near_duplicates
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.shared import Scratch, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """docs whose doc_id tells rows of the same doc_id apart by their texts."""
    return docs.select(*COLUMNS).withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs but for the named doc_ids of dropped."""
    dropped = Scratch(docs.sparkSession, name).save(dropped.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.text_hash").alias("_hash")).distinct(), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.select(*COLUMNS).join(small(dropped), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on their labels, rejects go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one equals or nearly equals go; so do documents that lose lines and keep nothing but white space."""
    kept = dedup_lines(docs, keep=("lang", "source", "n_chars"), run=RUN, short_equal=True)
    lost = F.col("n_equal") + F.col("n_near") > 0
    kept = kept.filter(~lost | F.col("text").rlike(r"(?U)\S"))
    chars = F.when(lost, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document that comes first stays."""
    return _without(docs, near_duplicates(_named(docs)).filter("doc_id <> component_id"), "near-copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return _without(docs, decontaminate(_named(docs), table(spark, sf_dir, "benchmark")).filter("contaminated"), "contaminated")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, target, taken (words, repeats counted) and epochs (whole repeats)."""
    mixed = mix_sources(_named(docs)).filter("taken > 0").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("size", "target", "taken", "epochs")))
    mixed = mixed.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.text_hash").alias("_hash"), "size", "target", "taken", "epochs")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.select(*COLUMNS).join(mixed, same).drop("_id", "_hash")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]
#: The classifier and the sieves of near copies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
