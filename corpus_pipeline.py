"""A corpus pipeline: quality, exact dedup, near dedup, mixing, packing. Part of the subpackage llm.

Stages take whole tables and whole texts. A null text counts as empty: the classifier scores it like an empty one, exact dedup keeps one of all empty
texts, near dedup links none of them, and mixing, which takes words, takes none. Very long texts are treated like others. Of tied or repeated rows
exact dedup keeps one, the one with the largest doc_id (any one of fully equal rows); near dedup keeps the smallest doc_id of a group. Extra
columns, whatever their names, are carried to the last stage but one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import exact_dedup, minhash, mixing, packing, quality
from loamline.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; those that the quality classifier scores higher are likelier."""
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.sampled_documents(docs, quality.weigher(model) if model else mixing.plain_share)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their places in the sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the classifier nor the sampling; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
