"""A corpus from raw documents to training sequences: every stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordermill.llm.common import table, written
from ordermill.llm.language import identified, learned
from ordermill.llm.mixing import mixed_documents, quality_weights
from ordermill.llm.packing import pack
from ordermill.llm.simhash import representatives
from ordermill.llm.toxicity import fitted, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, does not predict as toxic."""
    return without_toxic(docs, fitted(docs, table(spark, sf_dir, "labels")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language can be told."""
    return identified(docs, learned(docs))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates."""
    return representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs, quality_weights(table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in training sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_dedup", keep_representatives),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
