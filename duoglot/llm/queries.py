"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from duoglot.llm import (byte_bpe, chat_format, importance, language_id, multi_index, near_dedup, packing, page_text,
                         personal_data, quality, substring_dedup, token_counts, whitening)
from duoglot.llm.common import table
from duoglot.llm.oracles import ORACLES


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.cut_passages(table(spark, folder, "documents"), length=50)
    # Only single spaces join the kept words, also where nothing was removed.
    words = F.filter(F.split("kept_text", "[ \\t-\\r]+"), lambda w: w != "")
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN, specials=("<|endoftext|>",), limit=512)


def op3_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(table(spark, folder, "pages"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    rules = quality.quality_rules(documents, table(spark, folder, "labels"))
    return quality.judge(documents, rules)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, path))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").selectExpr(
        "CAST(conv_id AS bigint) AS conv_id", "CAST(turn AS bigint) AS turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], said.schema)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    formatted = chat_format.format_turns(said.unionByName(more), path, public_tokenizers.PATTERN)
    return chat_format.read_back(formatted, path, public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    fold = language_id.fold_of()
    model = language_id.train(documents.where(fold != 2), public_tokenizers.path("piece_bpe_32k.model"))
    rows = documents.select("doc_id", (fold == 2).alias("held_out"), "text")
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return multi_index.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), threshold=0.8, size=4)


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=10, least_words=20,
        longest=1, buckets=10_000, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, folder, "documents"))
    counts = [personal_data.spans_of("seeds", kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """A deviation beyond 64 bits is null here; the operator has it as a decimal."""
    return whitening.whiten(table(spark, folder, "embeddings"), count=8).withColumn(
        "deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {name: run for name, run in list(globals().items()) if name.startswith("op")}
