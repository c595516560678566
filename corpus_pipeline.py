"""A corpus pipeline: toxic documents go, then exact and near copies; the rest is mixed to target weights and packed.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and reread before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tidefold.llm.common import read, stored

#: Of the mixture's tokens, so many of good and of poor documents; toxic ones have gone before.
TARGETS = {(1, 0): 0.92, (0, 0): 0.08}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, read(spark, sf_dir, "labels"), targets=TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Classifiers, MinHash and tokenizer can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage{n}")
    return docs
