"""The registered queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import bpe, chat, langid, licences, media, mixing, neardup, negatives, repair, repeats, tokenfile, topk, wrapper
from evenhand.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_ngram_jaccard")
def op1(spark, sf):
    return neardup.classes(documents(spark, sf))


@query("op2_wrapper_induction")
def op2(spark, sf):
    return wrapper.main_text(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op3_bpe")
def op3(spark, sf):
    return bpe.digests(documents(spark, sf), VOCABULARY)


@query("op4_exact_top_k", topk.SQL)
def op4(spark, sf):
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op5_substring_dedup", repeats.SQL)
def op5(spark, sf):
    return repeats.removed(documents(spark, sf))


@query("op6_licence_scan", licences.sql())
def op6(spark, sf):
    return licences.scan(documents(spark, sf)).drop("saved")


@query("op7_token_file")
def op7(spark, sf):
    return tokenfile.written_and_read(documents(spark, sf), VOCABULARY)


@query("op8_mixing")
def op8(spark, sf):
    return mixing.taken(documents(spark, sf))


@query("op9_progressive_jpeg")
def op9(spark, sf):
    return media.stored_and_read(documents(spark, sf))


@query("op10_language_id")
def op10(spark, sf):
    return langid.predictions(documents(spark, sf))


@query("op11_chat_formatting", chat.SQL)
def op11(spark, sf):
    return chat.formatted_and_read(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op12_conversation_repair", repair.SQL)
def op12(spark, sf):
    return repair.repaired_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op13_hard_negatives", negatives.SQL)
def op13(spark, sf):
    return negatives.mined(spark.read.parquet(f"{sf}/embeddings.parquet"))
