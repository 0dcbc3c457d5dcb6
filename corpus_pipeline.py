"""A corpus from raw documents to token segments, in five stages.

Every stage reads all that the one before kept, as written Parquet. All but the last return the
columns of ``documents``; the last returns what its read-back of the written segments gives.

Defined results, beside those that the operators' docstrings state: null and blank texts fail the
quality rules and go there; repeated rows count once in the quality rules' lines and all but one go in
the near-duplicate stage, as do null-id copies of a document that has an id; a null source is a host
and a source of its own, last in order; an empty table stays empty through all stages; further columns
are carried along, whatever their names. Ids are integers or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statewake.llm import decontaminate, near_dup, quality_rules, source_mix, token_store
from statewake.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and frequent lines go from the others."""
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8)."""
    return near_dup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the source mix takes them."""
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token segments."""
    return token_store.store_tokens(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokens)]

#: Token ids, minima and schedules have no SQL; the test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
