"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; ``run`` writes each result as Parquet in the shared checkpoint folder and reads it back
as the next stage's ``docs``. All stages but the last return the columns of ``documents``, whatever
these are; the last returns the tokens.

Stages pass on whole rows, whatever their columns, and add or drop nothing but rows: null ids, ids
that repeat with other texts, and columns beyond those of ``documents`` go through (the operators'
docstrings say what they make of such rows). A null text leaves exact dedup as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import held_out, restored, table, written
from churnlens.llm.decontaminate import contamination, is_contaminated
from churnlens.llm.exact_dedup import exact_survivors
from churnlens.llm.queries import sentencepiece_model
from churnlens.llm.sentencepiece_tokens import encode
from churnlens.llm.simhash import simhash_survivors
from churnlens.llm.toxicity import toxicity

TOXIC = 0.5


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under ``TOXIC`` (operator 1)."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity(docs, labels, train_docs=table(spark, sf_dir, "documents"), carry=True)
    return restored(scored.where(F.col("score") < TOXIC), docs, "text")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id (operator 7)."""
    return exact_survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the least id (operator 9)."""
    return simhash_survivors(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark (operator 8)."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return restored(found.where(~is_contaminated()), docs, "text")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (operator 3): doc_id, n_tokens, ids, same."""
    rows = encode(docs, sentencepiece_model())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "same")


STAGES = [
    ("toxicity", toxic_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: a trained CRF, connected components and tokenization have no SQL twin; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
