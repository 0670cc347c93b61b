"""A corpus made ready for training: one language, no near copies, no repeated passages, mixed to target weights, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenhand.llm import bpe, langid, mixing, neardup, repeats
from evenhand.llm.catalog import VOCABULARY
from evenhand.llm.common import documents, small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one known language."""
    small_batches(spark)
    return langid.accept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return neardup.first_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one holds."""
    small_batches(spark)
    return repeats.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in its order."""
    small_batches(spark)
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, for each document of the mix."""
    small_batches(spark)
    return bpe.digests(docs, VOCABULARY)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("mixing sources", mix), ("BPE encoding and decoding", tokens)]

#: The models of the first stage and the encoding of the last can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage_" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
