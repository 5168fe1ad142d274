"""The corpus pipeline: quality rules, near copies, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from weftlink.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the model learns from the labelled ones among them."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every document; a document that the mixture repeats has several slots."""
    return sharding.interleave(sized(docs), tie=("doc_id", "text_crc32", "size"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", sharding.byte_size().alias("size"), sharding.text_crc().alias("text_crc32"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", cut_shards),
]

#: The first stage's model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
