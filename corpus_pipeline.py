"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewright.llm import decontaminate, mixing, neardup, quality, scratch, sharding  # noqa: E402

#: Target weights of the mix; nodes that are not named weigh 1.
WEIGHTS = {"d0": 1.0, "d1": 1.0, "d2": 1.0, "d3": 1.0, "d0/en": 2.0}
#: The part of all tokens that the mix keeps, and the seed of its order.
FRACTION, SEED = 0.9, 11
SHARDS = 40


def domain() -> F.Column:
    """The tables name no domain: sources are dealt to four by their last character."""
    return F.concat(F.lit("d"), F.expr("coalesce(ascii(right(source, 1)), 0) % 4").cast("string"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many different texts of their source share.

    Exact copies count once here: they are the next stage's, which keeps one.
    """
    return quality.clean(docs, copies_once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8 or more)."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one epoch selects for the target weights."""
    return mixing.selected(docs, domain(), WEIGHTS, FRACTION, SEED)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", deal_shards),
]

#: Near-dedup, decontamination and sharding are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
