"""A training corpus in five stages: toxicity, line dedup, near duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, ngram_jaccard, packing, toxicity
from tidemark.llm.common import free_name, stage, table
from tidemark.llm.labelled import THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold."""
    score = free_name("score", docs.columns)
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), docs.columns, score)
    return scored.filter(F.col(score) < THRESHOLD).drop(score)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the chunks of lines that came up before; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("_cut_chunks") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*[f"`{c}`" for c in docs.columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those whose doc_id is the only column of ids; null doc_ids stay."""
    name = free_name("_gone", docs.columns)
    gone = ids.toDF(name).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return _without(docs, ngram_jaccard.jaccard_classes(docs).filter("component_id != doc_id").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return _without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: SQL cannot express the factorization machine, the edit-distance search and the packing; tests/llm compares run() with plain loops over each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
