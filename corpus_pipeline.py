"""The corpus pipeline: documents go through the stages in order, each stage stored as Parquet
and read again by the next one.

Every stage returns the columns of ``documents`` (and any further ones it was given), the last
one returns the packed pieces. Empty tables, null ids and texts and repeated rows go through; see the
operators for what becomes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from duoglot.llm import language_id, near_dedup, packing, quality, substring_dedup
from duoglot.llm.common import gathered, stored, table

BROADCAST_IDS = 1_000_000
LOWEST_SCORE = 0.5


def _apart(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, rest)``: names of further columns cannot clash with an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("rest"))


def _together(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return rows.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    docs = gathered(docs)
    rules = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not ``und``, and a posterior of at least a half.
    The language itself, and the label, reject nothing."""
    docs = gathered(docs)
    model = language_id.train(docs.where(language_id.fold_of() != 2),
                              public_tokenizers.path("piece_bpe_32k.model"))
    judged = language_id.identify(_apart(docs), model)
    return _together(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LOWEST_SCORE)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    docs = gathered(docs)
    found = near_dedup.near_duplicates(docs, threshold=0.8, size=5)
    dropped = stored(found.where("NOT kept").select("doc_id").distinct(), "near-dropped", docs.count())
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)  # 8 bytes each, counted
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has as well; a text that is cut has its
    words joined by one space and ``n_chars`` anew. A text that loses all its words stays, empty."""
    docs = gathered(docs)
    cut = substring_dedup.cut_passages(_apart(docs), length=50)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return _together(cut, docs.columns, **changed)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    docs = gathered(docs)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality_rules", quality_rules), ("language_id", identify_language),
          ("minhash_near_dedup", near_duplicates), ("substring_dedup", repeated_passages),
          ("best_fit_packing", best_fit_packing)]

# Quality rules and languages are learned and tokens come from a vocabulary: no SQL for these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
