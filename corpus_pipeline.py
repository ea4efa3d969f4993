"""The training-text pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's documents.

A stage's result is written as Parquet and read again as the next one's docs, so a lost executor never costs more than
the stage it works on, and rows keep one order for all reads of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, quality_rules, simhash, substrings
from tidemark.llm.common import discard, free, materialize, stored


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or repeat themselves."""
    return quality_rules.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one document stays."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a window found elsewhere covers go; documents stay, even if nothing is left of one."""
    return substrings.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (flag,) = free(docs.columns, "contaminated")
    return decontaminate.contamination(docs, bench, flag=flag).where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", clean_lines),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]
#: SQL cannot express tokenizing and packing; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages leave; what a stage stored goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = stored()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            own = stored() - before
            docs = materialize(docs, "stage")
            discard(spark, *own)
    return docs
