"""The corpus pipeline: documents in, shard assignment of a clean, deduplicated, decontaminated mixture out.

Each stage works on all that its predecessor kept and returns the columns of documents; the last one returns the
place of every copy in the shards. Rows without a doc_id pass the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.llm import common, decontaminate, langid, mixing, near_dedup, sharding

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or too far from every language learned from the labels, go; with no labels all stay."""
    return langid.drop_undetermined(docs.select(*DOCUMENT_COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8): the one with the least doc_id."""
    return near_dedup.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS), percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to edits, go."""
    return decontaminate.drop_leaks(docs.select(*DOCUMENT_COLUMNS), common.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights: a document appears as often as it is taken; the one at a source's budget is cut."""
    mixed = mixing.apply_mix(docs.select(*DOCUMENT_COLUMNS))
    return mixed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in DOCUMENT_COLUMNS])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("sharding", shard)]

#: Language ID and the LSH of decontamination are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
