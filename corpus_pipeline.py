"""Corpus pipeline: keep good documents, drop exact and near copies, mix sources to weights, pack sequences.

Defined cases are those of the operators. Document ids are taken as unique from the mix on: rows that repeat an id are
each taken as often as the id is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from rxframe.llm.common import lean, table
from rxframe.session import settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, table(lean(spark), sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return exact_dedup.dedup(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return near_dedup.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return mixing.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("MinHash near-dedup", apart),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]
#: Neither the classifier nor the tokenizer can be expressed in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(lean(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
