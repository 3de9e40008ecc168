"""The analytic test tables seen as corpora and query tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents_as_corpus(documents: DataFrame) -> DataFrame:
    """Raw paragraphs: ``source`` is the book, ``doc_id`` the paragraph; English texts go
    on the translation side, all others on the Pali side."""
    english = F.col("lang").eqNullSafe("en")
    return documents.select(
        F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("para_id"),
        F.when(~english, F.col("text")).alias("pali_paragraph"),
        F.when(english, F.col("text")).alias("translation_paragraph"))


def conversations_as_corpus(conversations: DataFrame) -> DataFrame:
    """Raw paragraphs: a user turn and the assistant turn after it are two sides of one; either
    may be alone. System turns are paragraphs of their own, on the Chinese side in even and on the
    Russian side in odd conversations, so that every turn and all four sides are used."""
    user = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("pali_paragraph"))
    reply = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translation_paragraph"))
    ids = (F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("book_id"),)
    pairs = user.join(reply, ["conv_id", "turn"], "full").select(
        *ids, F.col("turn").cast("string").alias("para_id"), "pali_paragraph", "translation_paragraph")
    others = conversations.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    even = F.pmod("conv_id", F.lit(2)) == 0
    others = others.select(
        *ids, F.concat(F.lit("other"), F.col("turn").cast("string")).alias("para_id"),
        F.when(even, F.col("text")).alias("chinese_paragraph"),
        F.when(~even, F.col("text")).alias("russian_paragraph"))
    return pairs.unionByName(others, allowMissingColumns=True)


def benchmark_as_queries(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
