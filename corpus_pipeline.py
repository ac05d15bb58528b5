"""The documents from raw rows to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, written as Parquet.  Quality rules drop what they reject; of each
group of near-duplicates the document with the least doc_id stays; byte strings of 100 that start earlier are
cut out; sources are mixed so that none is repeated more than twice and every document appears at least once;
and what is left is packed into sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import mixing, neardup, packing, quality, suffixes
from veilspark.llm.queries import tokenizer_path
from veilspark.llm.store import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.keep(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, repetition=2.0)
    # Rows are written pass by pass and in each pass in the order of its blocks, so that what is packed follows the permutation.
    return mixed.orderBy("epoch", "block_key", "doc_key").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate and suffix stages are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
