"""Texts → unit vectors: the built-in hashing encoder and the model plug-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duoglot.functions.text import concat_nonempty, tokens
from duoglot.functions.vectors import (HASH_DIM, dense_from_sorted, hash_dimension, hash_sign,
                                       l2_normalize)
from duoglot.operators.skew import ROWS_PER_SPLIT, hot_keys, salted_join
from duoglot.operators.words import word_rows
from duoglot.session import work_folder
from duoglot.sources.index_tables import FETCH_IDS, one_of, path_exists

# A model plug-in: text column → array<float> column, for instance made with
# pyspark.ml.functions.predict_batch_udf(…, batch_size=MODEL_BATCH).
Encoder = Callable[[Column], Column]
MODEL_BATCH = 512
# Digests are broadcast up to this many (64 bytes each).
BROADCAST_DIGESTS = 1_000_000


def term_counts(texts: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``(keys…, term, tf)``. A text without any token counts as one empty term, so that
    it has a unit vector like every other text."""
    words = texts.select(*keys, F.explode_outer(tokens(text_col)).alias("term"))
    return (words.withColumn("term", F.coalesce("term", F.lit("")))
            .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))


def hash_vectors(counts: DataFrame, keys: Sequence[str], dim: int = HASH_DIM,
                 normalize: bool = True) -> DataFrame:
    """``(keys…, embedding)`` by signed feature hashing (Weinberger et al. 2009) of
    ``(keys…, term, tf)``. A key has at most ``dim`` entries to collect."""
    weights = (counts.select(*keys, hash_dimension("term", dim).alias("dim"),
                             (hash_sign("term") * F.col("tf")).alias("w"))
               .groupBy(*keys, "dim").agg(F.sum("w").alias("w")))
    entries = weights.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"),
        F.sort_array(F.collect_list(F.struct("dim", F.col("w").cast("double").alias("weight"))))
        .alias("entries"))
    scale = F.when(F.col("length") > 0, F.col("length")).otherwise(1.0) if normalize else 1.0
    return entries.select(*keys, dense_from_sorted("entries", dim, scale).alias("embedding"))


def _cells(terms: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of each term, as ``hash_dimension`` and ``hash_sign`` give them."""
    digests = [hashlib.md5(term.encode()).hexdigest() for term in terms]
    return (np.array([int(d[:7], 16) % dim for d in digests], dtype=np.int64),
            np.array([1.0 if d[7] < "8" else -1.0 for d in digests]))


def text_vectors(texts: DataFrame, keys: Sequence[str], text_col: str, dim: int = HASH_DIM) -> DataFrame:
    """``(keys…, embedding)``: the vectors of ``hash_encode`` for texts that are a row each. Every row is
    encoded where it is, in Arrow batches: no counts are gathered by key, and nothing is shuffled."""
    rows = texts.select(*keys, tokens(text_col).alias("words"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["embedding array<float>"]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text without any token counts as one empty term.
        silent = _cells([""], dim)
        for batch in batches:
            for part, row, terms, code in word_rows(batch):
                n = part.num_rows
                place, sign = _cells(terms.to_pylist(), dim)
                matrix = np.bincount(row * dim + place[code], sign[code], n * dim).reshape(n, dim)
                empty = np.diff(part.column("words").offsets.to_numpy()) == 0
                matrix[empty, silent[0][0]] = silent[1][0]
                length = np.sqrt((matrix * matrix).sum(axis=1))
                matrix = (matrix / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)
                offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keys], pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))],
                    names=[*keys, "embedding"])

    return rows.mapInArrow(vectors, ", ".join(kinds))


def hash_encode(texts: DataFrame, keys: Sequence[str], text_col: str, dim: int = HASH_DIM,
                normalize: bool = True) -> DataFrame:
    """Built-in encoder over a table of texts with unique ``keys``.

    The texts are distributed by key once; the three aggregations that follow reuse that
    distribution.
    """
    spread = texts.select(*keys, text_col).repartition(*[F.col(k) for k in keys])
    return hash_vectors(term_counts(spread, keys, text_col), keys, dim, normalize)


def _apply(df: DataFrame, text: Column, encoder: Encoder, on_empty: str, normalize: bool,
           output: str) -> DataFrame:
    """Missing texts are encoded as empty ones; ``on_empty="error"`` fails the job on an
    empty text instead."""
    if on_empty not in ("encode", "error"):
        raise ValueError("on_empty must be 'encode' or 'error'")
    text = F.coalesce(text, F.lit(""))
    if on_empty == "error":
        text = F.when(text == "", F.raise_error(F.lit("cannot encode an empty text"))
                      .cast("string")).otherwise(text)
    df = df.withColumn(output, encoder(text))
    vector = F.col(output)
    return df.withColumn(output, l2_normalize(vector) if normalize
                         else vector.cast("array<float>"))


def encode(df: DataFrame, text_col: str, encoder: Encoder, id_col: str | None = None,
           reuse: bool = True, on_empty: str = "encode", normalize: bool = True,
           output: str = "embedding", rows_per_split: int = ROWS_PER_SPLIT,
           store: str | None = None) -> DataFrame:
    """Add a unit vector per row with a plugged-in model.

    With ``reuse`` each distinct text is encoded once and the vectors are joined back by a
    digest of the text, so repeated texts cost one model call. A text that fills a large
    share of the rows is spread over several tasks by ``id_col``. With a ``store`` (see
    :func:`stored_vectors`) texts that earlier jobs have encoded are not encoded again.
    """
    if not reuse:
        return _apply(df, F.col(text_col), encoder, on_empty, normalize, output)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn("_digest", F.sha2(F.encode(text, "UTF-8"), 256))
    groups = keyed.groupBy("_digest").agg(
        F.first(text).alias("_text"), F.count(F.lit(1)).alias("_copies"))
    if store is None:
        vectors = _apply(groups, F.col("_text"), encoder, on_empty, normalize, output)
    else:
        vectors = stored_vectors(groups.select("_digest", "_text"), store, lambda new: _apply(
            new, F.col("_text"), encoder, on_empty, normalize, output), output)
    hot = hot_keys(groups.select("_digest", "_copies"), ["_digest"], "_copies", df.count(), rows_per_split)
    spread_by = id_col or df.columns[0]
    return (salted_join(keyed, vectors.select("_digest", output), ["_digest"], spread_by, hot)
            .drop("_digest"))


def stored_vectors(texts: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame],
                   output: str = "embedding") -> DataFrame:
    """``(_digest, output)`` of distinct texts ``(_digest, _text)``, from the Parquet table at ``path`` as
    far as it has them; the others are computed, added to it, and returned too.

    The table belongs to one model. It is sorted by digest within each job's files and carries a Bloom
    filter: a few texts are looked up without reading the rest, more of them in one scan that
    shuffles only what is found. Only finished jobs are seen; a failed one adds nothing.
    """
    spark = texts.sparkSession
    work_folder(spark)
    asked = texts.select("_digest").checkpoint()
    few = asked.limit(FETCH_IDS + 1).count() <= FETCH_IDS
    ids = [r["_digest"] for r in asked.collect()] if few else None

    def known() -> DataFrame:
        if not path_exists(spark, path):
            return spark.createDataFrame([], f"_digest string, {output} array<float>")
        table = spark.read.schema(f"_digest string, {output} array<float>").parquet(path)
        table = table.where(one_of("_digest", sorted(ids))) if few else table.join(
            F.broadcast(asked) if asked.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else asked,
            "_digest", "left_semi")
        # Two jobs at the same time may have added the same text.
        return table.groupBy("_digest").agg(F.first(output).alias(output))

    new = texts.join(known().select("_digest"), "_digest", "left_anti")
    (compute(new).select("_digest", output).sortWithinPartitions("_digest").write.mode("append")
     .option("parquet.bloom.filter.enabled#_digest", "true").parquet(path))
    return known()


def named_texts(corpus: DataFrame, text_columns: dict[str, str],
                fused: str = "multilingual") -> DataFrame:
    """``(doc_id, vector_name, text)``: one row per language column, plus the fused text of
    all non-empty ones. A column that the corpus lacks is an error."""
    absent = sorted(set(text_columns.values()) - set(corpus.columns))
    if absent:
        raise ValueError(f"no such text columns: {', '.join(absent)}")
    present = text_columns
    named = [F.struct(F.lit(n).alias("vector_name"),
                      F.coalesce(F.col(c), F.lit("")).alias("text"))
             for n, c in present.items()]
    named.append(F.struct(F.lit(fused).alias("vector_name"),
                          concat_nonempty(list(present.values())).alias("text")))
    return (corpus.select("doc_id", F.explode(F.array(*named)).alias("v"))
            .select("doc_id", "v.vector_name", "v.text"))
