"""A corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, folder); all but the last return the columns of documents.
A stage works on all rows that its predecessor kept.  Rows with null texts, null or repeated
ids pass as each operator's docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoframe.llm import jaccard, mixing, packing, quality, toxicity
from geoframe.llm.queries import tokenizer
from geoframe.llm.shared import cut


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality.keep_good(docs, _labels(spark, folder))


def civil(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    return toxicity.keep_civil(docs, _labels(spark, folder))


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, with the group's smallest id."""
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of tokens."""
    return mixing.drawn(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The drawn documents' pieces, packed into sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality", good_quality),
    ("toxicity", civil),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models, sampling and tokens aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, folder)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
