"""The training-data pipeline: toxicity, quality rules, SimHash near-dedup,
mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns rows with the columns of ``documents``; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm import mixing, packing, quality, simhash, toxicity
from rainfold.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 7) calls toxic go."""
    p = toxicity.Ftrl()
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), p)
    return toxicity.drop_toxic(docs, model, p)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule (operator 2) go."""
    return quality.keep_good(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 4) stays."""
    return simhash.keep_one(docs, shingle=3, max_distance=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the expected tokens of the languages
    meet the target weights (operator 8); every document stays."""
    return mixing.repeat_rows(docs, docs.withColumn("domain", F.col("lang")), mixing.TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are packed into sequences (operator 9); the copies of a document
    are one cluster and so never meet in a sequence."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: learned scores, SimHash fingerprints and sequential packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the
    shared folder and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
