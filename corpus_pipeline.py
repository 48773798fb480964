"""A training corpus from `documents`: toxic texts go, one of each group of near copies stays, texts with benchmark passages go, secrets are
masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return docs' columns. Stages work on whatever rows
they are given. In every stage: null text counts as empty; repeated rows are rows of their own (near_dedup keeps one of them); null ids are ids; texts may be of any
length; further columns stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm import decontaminate, near_copies, packing, secrets, toxicity
from turnmill.llm.common import cache_path, drop, release, table
from turnmill.llm.language import remainder
from turnmill.session import new_path, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what scores 0.5 or more; the model learns from labelled documents outside the held-out fifth. A score of exactly 0.5 goes; without labels of both kinds
    the score is the share of label 1."""
    learn = F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), learn))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of texts whose 5-word shingles are similar by 0.8 or more (null ids last; of several rows with that id, one).
    All empty texts are one group."""
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs. Empty texts and items hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes, and a null text stays null. Spans that overlap are masked as one."""
    return secrets.redact(docs, cache_path(spark, "blob-ledger"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; an empty text is one piece, the end id."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            drop(spark, before)  # written and read: the stage before is read no more
        before = path
        release()
        spark._jvm.System.gc()  # a stage's plans and results are garbage now: the driver's heap shrinks before the next
    return docs


#: A trained classifier and a tokenizer take part, so SQL can't express it; tests compare each stage with brute force.
ORACLE_SQL = None
