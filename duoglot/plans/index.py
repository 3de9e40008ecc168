"""Corpus → index: build, upsert, compact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duoglot.config import CorpusConfig
from duoglot.functions.text import uuid5_dns
from duoglot.operators import lexical
from duoglot.operators.codes import Codes
from duoglot.operators.corpus import FOLDED_SUFFIX
from duoglot.operators.encode import Encoder, encode, named_texts, text_vectors
from duoglot.operators.topk import best_row_per_key
from duoglot.session import work_folder
from duoglot.sources.index_tables import (CONCURRENT_WRITERS, DOCS_SCHEMA, OPEN_FILES, RANGE_DOCS, Index, IndexSettings,
                                          open_or_declare)

FUSED = "multilingual"
# A bucket of more text than this is split in two by compaction.
BUCKET_BYTES = 256 << 20
# Spark's switch for reading a bucketed table by splits where no step needs the buckets.
BUCKETED_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
CONCAT = "multilingual_concat"
# Text column of each language vector, when vectors per language are asked for.
LANGUAGE_COLUMNS = {"pali": "pali_paragraph", "en": "translation_paragraph",
                    "zh": "chinese_paragraph", "ru": "russian_paragraph"}


def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def index_payload(corpus: DataFrame) -> DataFrame:
    """The stored columns of a paragraph. Ids and the concatenated text are required;
    the other texts come from the first accepted column of their language and default to
    null."""
    required = ("doc_id", "book_id", "para_id", CONCAT)
    for name in required:
        if name not in corpus.columns:
            raise ValueError(f"the corpus lacks the column {name}")
    found = CorpusConfig().resolve(corpus.columns)
    source = {f"{name}{suffix}": f"{found[lang]}{suffix}" for lang, name in LANGUAGE_COLUMNS.items()
              if lang in found for suffix in ("", FOLDED_SUFFIX)}

    def column(name: str) -> Column:
        chosen = name if name in corpus.columns else source.get(name)
        kept = F.col(chosen) if chosen in corpus.columns else F.lit(None)
        return kept.cast("string").alias(name)

    columns = [column(f.name) for f in DOCS_SCHEMA if f.name != "uuid"]
    return corpus.select(uuid5_dns("doc_id").alias("uuid"), *columns)


def latest_rows(corpus: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One row per ``doc_id``, the later one winning.

    Without a version column in ``order`` the larger text wins, so that the result does
    not depend on how the input is split."""
    return best_row_per_key(corpus, ["doc_id"], [
        *(order or []), F.desc(CONCAT),
        *[F.desc_nulls_last(c) for c in ("pali_paragraph", "translation_paragraph",
                                         "book_id", "para_id") if c in corpus.columns]])


def _vectors(docs: DataFrame, settings: IndexSettings, encoder: Encoder | None,
             store: str | None = None) -> DataFrame:
    """``(doc_id, vector_name, embedding)`` of indexed docs."""
    if settings.vector_columns:
        texts = named_texts(docs, dict(settings.vector_columns), FUSED)
    else:
        texts = docs.select("doc_id", F.lit(FUSED).alias("vector_name"),
                            F.coalesce(CONCAT, F.lit("")).alias("text"))
    keys = ["doc_id", "vector_name"]
    if encoder is None:
        return text_vectors(texts, keys, "text").select("doc_id", "vector_name", "embedding")
    return encode(texts, "text", encoder, id_col="doc_id", store=store).select(*keys, "embedding")


@contextmanager
def _conf(spark: SparkSession, name: str, value: str):
    """A setting of the session for the length of some jobs."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def upsert_index(index: Index, corpus: DataFrame, order: Sequence[Column] | None = None,
                 encoder: Encoder | None = None, batch: str | None = None,
                 vector_store: str | None = None) -> Index:
    """Add the paragraphs of ``corpus``; one with a known ``doc_id`` replaces the old row.

    Only the new rows are written; the rows they replace are noted in ``replaced``. The old
    texts of those are fetched by id and split into words once, for both statistics; the
    postings are not read. The cost follows the size of ``corpus``, apart from one look-up
    of its ids among those of the index (the id column alone). A ``batch`` name that is already in the manifest is skipped.
    One writer at a time. ``vector_store`` is a table of the encoder's vectors by text that is kept
    across jobs, so no text is encoded a second time.
    """
    if batch is not None and any(g[2] == batch for g in index.generations):
        return index
    seq, gen = index.next_generation()
    rows = index_payload(latest_rows(corpus, order))
    if index.settings.buckets != _shuffle_partitions(index.spark):
        # Otherwise the rows already arrive as one task per bucket.
        rows = rows.repartition(index.settings.buckets, "doc_id")
    index.write_bucketed("docs", rows, gen)
    docs = index.of_generation("docs", gen).drop("gen")

    # In the order of documents: the ids and lengths of a document take next to nothing, and a scan for few ranges
    # skips the rest. A sort by terms would hold, and spill, a bucket's postings.
    ranged = index.ranged(docs, seq)
    with _conf(index.spark, BUCKETED_SCAN, "false"), _conf(index.spark, CONCURRENT_WRITERS, str(OPEN_FILES)):
        index.write_bucketed("postings", lexical.postings(ranged, index.settings.fields, ["doc_range"]), gen)
    posted = index.of_generation("postings", gen)

    n_rows = docs.count()
    old = sum(g[3] for g in index.generations)
    term_stats = lexical.term_statistics(posted)
    field_stats = lexical.field_statistics(posted)
    n_replaced = 0
    if old:
        dead = index.doc_generations().join(docs.select("doc_id"), "doc_id", "left_semi")
        index.write_small("replaced", dead.select("doc_id", F.col("gen").alias("dead_gen")), gen)
        dead = index.of_generation("replaced", gen).select(
            "doc_id", F.col("dead_gen").alias("gen"))
        n_replaced = dead.count()
        if n_replaced:
            work_folder(index.spark)
            gone = lexical.postings(index.replaced_docs(dead, n_replaced), index.settings.fields).checkpoint()
            term_stats = (term_stats.unionByName(
                lexical.term_statistics(gone).withColumn("df", -F.col("df")))
                .groupBy("field", "term").agg(F.sum("df").alias("df"))
                .where(F.col("df") != 0))
            field_stats = field_stats.unionByName(lexical.field_statistics(gone).select(
                "field", (-F.col("n_docs")).alias("n_docs"), (-F.col("sum_dl")).alias("sum_dl")))
    def write_vectors() -> None:
        index.write_bucketed("vectors", _vectors(docs, index.settings, encoder, vector_store), gen)
        index.write_codes(gen)

    def write_impacts() -> None:
        if index.settings.range_docs:
            index.write_small("impacts", lexical.impacts_of_docs(ranged, index.settings.fields), gen)

    # Independent of each other: their tasks share the cluster.
    # Docs are read by one task per bucket, in the order of its file, although no step asks for rows
    # by ``doc_id``: what is derived then falls into one file per bucket, and a range's documents are neighbours.
    with (_conf(index.spark, BUCKETED_SCAN, "false"), _conf(index.spark, CONCURRENT_WRITERS, str(OPEN_FILES)),
          ThreadPoolExecutor() as jobs):
        for job in (jobs.submit(write_vectors),
                    jobs.submit(index.write_small, "term_stats", term_stats, gen),
                    jobs.submit(index.write_small, "field_stats", field_stats, gen),
                    jobs.submit(write_impacts)):
            job.result()
    return index.finish(seq, gen, batch, n_rows, n_replaced)


def build_index(spark: SparkSession, corpus: DataFrame, path: str,
                fields: Sequence[str] = (CONCAT,),
                vector_columns: Mapping[str, str] | None = None,
                encoder: Encoder | None = None, buckets: int | None = None,
                order: Sequence[Column] | None = None,
                vector_store: str | None = None, codes: Codes | None = None,
                range_docs: int = RANGE_DOCS) -> Index:
    """Create the index at ``path`` if there is none and add ``corpus`` to it.

    ``buckets`` should bring a bucket to a few hundred MB; it defaults to the session's
    shuffle partitions (with which the docs are written without an extra shuffle), and
    compaction adjusts it to the stored bytes. ``vector_columns`` (name → text column) adds
    a vector per language to the fused one. ``codes`` adds an inverted table of the vectors, for
    searches with ``probes``; ``range_docs`` is how many documents share a bound per term (0: no bounds).
    """
    buckets = buckets or _shuffle_partitions(spark)
    settings = IndexSettings(tuple(fields), buckets, dict(vector_columns or {}), codes, range_docs)
    return upsert_index(open_or_declare(spark, path, settings), corpus, order, encoder,
                        vector_store=vector_store)


def fitting_buckets(n_bytes: int, buckets: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """``buckets``, doubled until none holds more than ``bucket_bytes`` on average. Doubling splits
    every bucket in two and moves no row between others."""
    while n_bytes > buckets * bucket_bytes:
        buckets *= 2
    return buckets


def compact_index(index: Index, path: str, encoder: Encoder | None = None,
                  bucket_bytes: int = BUCKET_BYTES) -> Index:
    """A fresh index at ``path`` with the current rows in one generation, and as many buckets
    as the measured bytes of its texts ask for."""
    n_bytes = index.docs().agg(F.sum(F.octet_length(CONCAT))).first()[0] or 0
    return build_index(index.spark, index.docs(), path, index.settings.fields,
                       index.settings.vector_columns, encoder,
                       fitting_buckets(n_bytes, index.settings.buckets, bucket_bytes),
                       codes=index.settings.codes, range_docs=index.settings.range_docs)


def index_summary(index: Index) -> DataFrame:
    """``(count, vector)``: rows given to the last upsert after keeping one per key."""
    return index.spark.createDataFrame(
        [(index.generations[-1][3], FUSED)], "count bigint, vector string")
