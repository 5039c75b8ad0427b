"""Corpus pipeline over ``documents``: toxicity, quality, near-duplicates, packing.

Each stage is written as Parquet in the shared folder and read back as the next one's documents. Counted as part of
the training-data subpackage.

Edge cases, the same in all stages: a null text is read as an empty one and stays null in what is kept; rows without
doc_id are judged by their text, and the near-duplicate stage, which names documents by id, keeps them; repeated rows are
scored each, and leave one after the near-duplicate stage; rows that share a doc_id are judged each; ties go to the
smallest doc_id; without both labels among the documents that are left, a classifier scores the rate of label 1; without
any label neither removes a document; columns other than doc_id and text, whatever their names,
travel along up to packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvspark.llm import ftrl, gam, near_copies, packing
from kvspark.llm.common import ship_code, stage, table, unstage
from kvspark.llm.tokens import default_vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; learns from the labelled ones among ``docs``."""
    ship_code(spark)
    return ftrl.without_toxic(docs, ftrl.fit(docs, table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; learns from the labelled ones among ``docs``."""
    ship_code(spark)
    return gam.without_junk(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five-word shingles, Jaccard 0.8 or more, exactly."""
    ship_code(spark)
    return near_copies.without_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row a piece."""
    ship_code(spark)
    return packing.pack(docs, default_vocabulary(), end_id=0, capacity=2048)


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near_duplicates", without_near_copies), ("packing", packed)]

#: Trained models, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        kept = stage(function(spark, docs, sf_dir), name)
        unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
