"""A corpus pipeline over documents: each stage works on what its predecessor kept.

STAGES in order: toxic documents go; repeated three-line runs go; one document of each near-duplicate group stays; sources are mixed
to their target weights; documents are packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import line_dedup, mixing, near_dedup, packing, toxicity
from kinmatch.llm.common import written
from kinmatch.llm.encoding import default_tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labelled ones here, doesn't call toxic.

    Unless both classes are labelled, nothing can be told apart and every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.training_rows(docs, labels))
    if not model.both_classes:
        return docs
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three consecutive lines; every document stays."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates, linked at a Jaccard similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, near_dedup.AT_80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, up to three times each."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The toxicity and packing stages can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
