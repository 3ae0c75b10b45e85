"""The corpus pipeline: documents become shards of clean, distinct, uncontaminated text in target proportions.

Each stage takes (spark, docs, sf_dir) and returns what it kept, which is written as Parquet and read
again for the next. All but the last return the columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkdoc.llm import decontaminate, mixing, sharding, simhash, toxicity
from sparkdoc.llm._spark import Scratch, freeing

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal regression trained on the labelled documents; those it finds toxic go."""
    model = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of any benchmark item occurs go: one leaked passage is enough."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"), min_items=1)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as brings the languages to their target weights; every document stays at least once."""
    return mixing.remix(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot; equal texts share a shard."""
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
    ("sharding", assign_shards),
]

#: SQL can express neither the trained models nor the packing; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    with Scratch(spark) as scratch:
        docs = _table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            with freeing():  # what a stage kept for its result goes as soon as that is written
                kept = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            scratch.drop(docs)
            docs = kept
    return docs
