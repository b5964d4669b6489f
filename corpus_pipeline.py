"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

toxicity (7)             documents that score as toxic go
near_dedup (4)           one document of each near-duplicate group stays, the one with the smallest doc_id
decontamination (3)      documents into which a benchmark item leaks go
pii (2)                  personal values and terms that reveal them are replaced in the texts
mixing (8)               the rest is mixed to target weights: a row for each slot of the mix

Null and empty texts, repeated rows, null or repeated doc_ids and empty tables go through every stage by the results
that its operator's module defines; rows with one doc_id and different texts stay apart.

All stages but the last return the columns of ``documents``.  SQL can't express the
stages; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, near_dup, pii, toxicity
from quern.llm.common import table, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that this stage gets, but for the held-out fifth."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.without_toxic(docs, model)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more.  Texts are told apart by themselves, so different ones under one doc_id, or under none, stay."""
    return near_dup.distinct_documents(docs, near_dup.Settings(words=5, percent=80))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontamination),
    ("pii", _pii),
    ("mixing", _mixing),
]

#: The stages learn, hash and draw; no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
