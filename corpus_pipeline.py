"""The corpus pipeline over ``documents``.

Stages take (spark, docs, sf_dir), work on all that the stage before kept, and
return the columns of ``documents``, but for the last, which returns a row for
each document of the written token files. Each result is written as Parquet and
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import decontaminate, mixing, quality, scratch, simhash, tokens
from lakewarden.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand on a failed host go."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets in training order; a document may come twice."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written as seekable files in training order - that in which the stage before wrote its rows - and read back."""
    return tokens.tokenize(docs, order_by=tokens.written_order(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Fingerprints and token ids are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; every result but the last is staged in the shared folder until the next one is, and what a stage staged itself goes with it."""
    docs, held = table(spark, sf_dir, "documents"), None
    for place, (name, step) in enumerate(STAGES):
        if place == len(STAGES) - 1:
            docs = step(spark, docs, sf_dir)  # the token files are the result, and are written by now
        else:
            with scratch.discarding(spark):
                docs = scratch.stage_kept(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if held is not None:
            scratch.discard(held)
        held = docs
    return docs
