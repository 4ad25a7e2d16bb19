"""Corpus pipeline over ``documents``: quality, lines, near-duplicates, passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.llm import line_dedup, ngram_join, packing, quality, suffix_automaton
from scholarmill.llm.common import materialise

#: The tokenizer definition that packing uses.
DEFINITION = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more stay, untouched. Learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal and nearly equal lines stay once; a document that loses all its words goes."""
    kept = line_dedup.line_dedup(docs, others=("lang", "source"))
    kept = kept.where("n_removed = 0 OR text RLIKE '[\\\\p{L}\\\\p{N}]'")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    groups = ngram_join.ngram_jaccard_join(docs)
    first = groups.where("doc_id = component_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document holds go; a document that loses all its words goes."""
    kept = suffix_automaton.substring_dedup(docs, others=("lang", "source")).where("n_removed = 0 OR n_removed < n_words")
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path(DEFINITION))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]
#: The classifier, the joins and the packing have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k + 1}")
    return docs
